"""Nested cross-validation: inner folds, and that nothing of an outer fold
reaches its inner fits."""

import random

import pytest
from pyspark.sql import functions as F

from riskfold.config import Cohort, Settings
from riskfold.operators import boost as B
from riskfold.operators import split as S
from riskfold.plans import nested as N

COHORT = Cohort("t", "T", "y", numeric=("a", "b"), categorical=("c",), iqr_columns=("a",))
SET = Settings(n_folds=3, iqr_multiplier=1.5)


@pytest.fixture(scope="module")
def dev(spark):
    rnd = random.Random(4)
    rows = [(f"r{i}", i % 3, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.choice("uvw")) for i in range(360)]
    rows = [(r, f, a, b, c, int(a + 0.3 * rnd.gauss(0, 1) > 0.5)) for r, f, a, b, c in rows]
    return spark.createDataFrame(rows, "row_id string, fold int, a double, b double, c string, y int")


def test_inner_folds_equal_the_single_operator(dev):
    inner, k = N.inner_assignment(dev, "y", 42, 3)
    assert k == 3
    got = {(r.outer, r.row_id): r.inner_fold for r in inner.collect()}
    for o in range(3):
        own = dev.where(F.col("fold") != o)
        want = {(o, r.row_id): r.inner_fold for r in S.inner_folds(own.drop("fold"), "y", 42).collect()}
        assert {key: v for key, v in got.items() if key[0] == o} == want


def test_too_few_rows_of_a_class_fail(spark):
    few = spark.createDataFrame([(str(i), i % 3, int(i < 4)) for i in range(60)], "row_id string, fold int, y int")
    with pytest.raises(ValueError):
        N.inner_assignment(few, "y", 42, 3)


def test_rows_of_the_outer_fold_change_nothing_before_they_are_scored(spark, dev):
    """Labels, values and categories of outer fold 0 are all replaced: what is
    fitted for fold 0 stays the same, what is fitted for fold 1 does not."""
    planted = dev.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y"))) \
                 .withColumn("a", F.when(F.col("fold") == 0, F.col("a") * 50 + 1000).otherwise(F.col("a"))) \
                 .withColumn("c", F.when(F.col("fold") == 0, F.lit("leak")).otherwise(F.col("c")))
    specs = {"s": ("stumps", dict(rounds=5, rate=0.5)), "t": ("trees", dict(trees=3, rate=0.3, depth=2))}

    def fitted(table):
        m, k = N.nested_matrices(spark, table, COHORT, SET)
        models = B.fit_many(m.train, m.n_features, specs, columns=m.kept)
        names = lambda j: m.features[j] if j >= 0 else None
        out = {}
        for g in m.kept:
            stumps = [(names(j), b, s, a) for j, b, s, a in models["s"][1][g]]
            trees = [([names(f) for f in t.feat], t.thr, t.value) for t in models["t"][1][g]]
            cuts = {m.features[j]: models["s"][0][g][j].tolist() for j in m.kept[g]}
            out[g] = (stumps, trees, cuts)
        return out, k

    (clean, k), (leaked, _) = fitted(dev), fitted(planted)
    assert set(clean) == set(range(3 * (k + 1)))
    assert all(clean[g] == leaked[g] for g in range(k + 1))
    assert all(clean[g] != leaked[g] for g in range(k + 1, 2 * (k + 1)))


def test_each_outer_fold_has_one_choice_and_its_metrics(spark, dev):
    grid = {"flat": ("stumps", dict(rounds=1, rate=0.1)), "deep": ("trees", dict(trees=8, rate=0.3, depth=3))}
    rows = N.nested_cv(spark, "", COHORT, SET, grid, dev=dev).collect()
    assert len(rows) == 6 and all(r.n_inner == 3 for r in rows)
    for o in range(3):
        mine = [r for r in rows if r.fold == o]
        best = max(mine, key=lambda r: (r.inner_pr_auc, r.config == "deep"))
        assert [r.config for r in mine if r.chosen] == [best.config]
        assert all((r.pr_auc is not None) == r.chosen for r in mine) and best.roc_auc > 0.85
