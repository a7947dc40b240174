"""Kendall by inversions, variances without products, column checks, and that
no part of a fitted recipe has seen the rows it is applied to."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import checks as CK
from riskfold.operators import prep as P
from riskfold.operators import profile as PR
from riskfold.operators import split as S
from riskfold.operators import stability as ST


def _pairwise_tau(a, b):
    signs = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i, j in itertools.combinations(range(len(a)), 2)]
    x, y = sum(abs(s) for s, _ in signs), sum(abs(t) for _, t in signs)
    if not x or not y:
        return 1.0 if all(s == t for s, t in signs) else 0.0
    return sum(s * t for s, t in signs) / math.sqrt(x * y)


def test_kendall_by_inversions_equals_all_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 3, 4, 7, 33, 80):
        for ties in (1, 2, n + 1):
            for _ in range(6):
                a, b = rng.integers(0, ties, n).astype(float), rng.integers(0, ties, n).astype(float)
                assert ST.kendall_tau(a, b) == pytest.approx(_pairwise_tau(a, b), abs=1e-12)
    assert ST.kendall_tau(np.arange(50_000.0), -np.arange(50_000.0)) == -1.0


@pytest.mark.parametrize("parts", [1, 7])
def test_variances_need_no_products_of_columns(spark, parts):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(1e6, 1, 300), rng.normal(size=300), np.full(300, 5.0)])
    df = spark.createDataFrame([(int(i % 2), [float(v) for v in r]) for i, r in enumerate(x)], "g int, x array<double>").repartition(parts)
    got = {(r.g, r.j): (r.n, r.var_samp) for r in P.variances(df).collect()}
    for g in (0, 1):
        for j in range(3):
            assert got[(g, j)][0] == 150 and got[(g, j)][1] == pytest.approx(np.var(x[g::2, j], ddof=1), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("tile, cells", [(256, 4_000_000), (3, 40), (2, 8)])
def test_tiles_find_the_planted_pairs(spark, tile, cells):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)) * 3 + 50
    x[:, 3], x[:, 6], x[:, 7] = 2 * x[:, 0] + 0.1 * rng.normal(size=400), -x[:, 5], 4.0
    df = spark.createDataFrame([(int(i % 2), [float(v) for v in r]) for i, r in enumerate(x)], "g int, x array<double>").repartition(5)
    found = P.correlated_pairs(df, P.variances(df).collect(), {0: list(range(8)), 1: [0, 1, 3]}, 0.9, tile, cells, cells).collect()
    got = {(r.g, r.i, r.j): r.r for r in found}
    assert set(got) == {(0, 0, 3), (0, 5, 6), (1, 0, 3)}
    for (g, i, j), r in got.items():
        assert r == pytest.approx(np.corrcoef(x[g::2, i], x[g::2, j])[0, 1], abs=1e-9)


def test_column_checks_count_what_was_planted(spark):
    good = spark.createDataFrame([("r", 1, 0.5, 1.5)], "row_id string, y int, a double, b double")
    assert all(r.ok for r in CK.validate_columns(good, good, "y").collect())
    bad = good.select("row_id", F.col("b").cast("string").alias("b"), "a", F.lit(1).alias("extra"))
    got = {r.check: r.n_violations for r in CK.validate_columns(good, bad, "y").collect()}
    assert got == {"no_target": 1, "unshared_column": 2, "other_order": 2, "not_numeric": 1}


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", int(i % 3), float(a), float(b), str(c), int(a > 0)) for i, (a, b, c) in
            enumerate(zip(rng.normal(size=240), rng.normal(size=240), rng.choice(["u", "v", "w"], 240)))]
    return spark.createDataFrame(rows, "row_id string, fold int, a double, b double, c string, y int")


def test_every_fitted_part_comes_from_the_training_rows_alone(folded):
    """Fences, medians, means, deviations, modes, categories and the selector
    of fold 0 stay when fold 0's own rows are replaced; those of fold 1 don't."""
    changed = folded.select("row_id", "fold", F.when(F.col("fold") == 0, F.col("a") * 90 + 500).otherwise(F.col("a")).alias("a"),
                            F.when(F.col("fold") == 0, F.col("a") * 90 + 500).otherwise(F.col("b")).alias("b"),
                            F.when(F.col("fold") == 0, F.lit("new")).otherwise(F.col("c")).alias("c"), "y")

    def fitted(dev):
        train = S.train_view(dev, 3)
        f = P.fit(train, ["a", "b"], ["c"], ["a"], 1.5, dev, S.fold_fits(3))
        flist = P.global_feature_list(f)
        kept = P.select_features(f, P.transform_array(train, f, flist), flist)
        parts = {"bounds": f.bounds, "num": f.num, "cat": f.cat, "counts": f.counts, "features": f.features, "kept": kept.select("g", "feature", "kept", F.round("var_samp", 9))}
        return {name: {g: sorted([tuple(r)[1:] for r in rows if r["g"] == g], key=str) for g in (0, 1)} for name, df in parts.items() for rows in [df.collect()]}

    before, after = fitted(folded), fitted(changed)
    for name in before:
        for a, b in zip(before[name][0], after[name][0]):
            assert a == pytest.approx(b) if all(isinstance(v, float) for v in a) else [round(v, 9) if isinstance(v, float) else v for v in a] == [round(v, 9) if isinstance(v, float) else v for v in b]
        assert before[name][1] != after[name][1]


def test_profiles_of_one_evaluation(folded):
    a = np.array([r.a for r in folded.collect()])
    row = PR.describe_numeric(folded, ["a", "b"]).where("column = 'a'").first()
    assert (row["count"], row.q50, row["max"]) == (240, pytest.approx(np.median(a)), a.max())
    q1, q3 = np.quantile(a, [0.25, 0.75])
    out = PR.outlier_counts(folded, ["a"]).first()
    assert out.n_outliers == ((a < q1 - 1.5 * (q3 - q1)) | (a > q3 + 1.5 * (q3 - q1))).sum()
    own = np.array([r.a for r in folded.collect() if r.fold == 1])
    by = {r.fold: r.n_outliers for r in PR.outlier_counts(folded, ["a"], fit="fold = 1", by="fold").collect()}
    q1, q3 = np.quantile(own, [0.25, 0.75])
    assert by[1] == ((own < q1 - 1.5 * (q3 - q1)) | (own > q3 + 1.5 * (q3 - q1))).sum() and set(by) == {0, 1, 2}
    box = {r.fold: r.median for r in PR.box_stats(folded, "a", "fold").collect()}
    assert box[1] == pytest.approx(np.median(own))
