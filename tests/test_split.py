"""Stratified split, folds and hashed ranks."""

import pytest
from pyspark.sql import functions as F

from riskfold.functions.ranking import hashed_rank
from riskfold.operators import split as S


def _frame(spark, n0, n1):
    rows = [(f"r{i}", 0) for i in range(n0)] + [(f"s{i}", 1) for i in range(n1)]
    return spark.createDataFrame(rows, "row_id string, target int")


def test_split_quotas(spark):
    out = S.stratified_split(_frame(spark, 50, 50), "target", 42, 0.2)
    c = {(r.split, r.target): r["count"] for r in out.groupBy("split", "target").count().collect()}
    assert c == {("test", 0): 10, ("test", 1): 10, ("train", 0): 40, ("train", 1): 40}


def test_folds_balanced_and_exhaustive(spark):
    out = S.stratified_folds(_frame(spark, 400, 100), "target", 5, 42)
    c = {(r.fold, r.target): r["count"] for r in out.groupBy("fold", "target").count().collect()}
    assert all(c[(f, 0)] == 80 and c[(f, 1)] == 20 for f in range(5))
    assert out.count() == 500 and out.select("row_id").distinct().count() == 500


def test_folds_unshuffled_same_counts(spark):
    out = S.stratified_folds(_frame(spark, 43, 17), "target", 5, 42, shuffle=False)
    sizes = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert sizes == [12, 12, 12, 12, 12]


def test_folds_raise_when_every_class_small(spark):
    with pytest.raises(ValueError):
        S.stratified_folds(_frame(spark, 3, 1), "target", 5, 42)


def test_inner_fold_rule(spark):
    assert S.inner_fold_count(_frame(spark, 30, 12), "target") == 3
    assert S.inner_fold_count(_frame(spark, 30, 5), "target") == 2
    with pytest.raises(ValueError):
        S.inner_fold_count(_frame(spark, 30, 1), "target")


def test_hashed_rank_dense(spark):
    df = _frame(spark, 300, 50).withColumn("h", F.md5("row_id"))
    r = hashed_rank(df, ["target"], "h", "row_id", digits=1)
    got = {t: sorted(x.rank for x in r.where(F.col("target") == t).collect()) for t in (0, 1)}
    assert got[0] == list(range(300)) and got[1] == list(range(50))


def test_fold_expansion_roles(spark):
    dev = S.stratified_folds(_frame(spark, 20, 10), "target", 5, 42)
    ex = S.fold_expand(dev, 5)
    per = {r.g: r["count"] for r in ex.where("role = 'train'").groupBy("g").count().collect()}
    assert per[-1] == 30 and all(per[g] == 24 for g in range(5))
