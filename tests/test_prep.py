"""Fences, quantiles, imputation, scaling, encodings, weights, selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.functions import quantiles as QN
from riskfold.functions.quantiles import exact_quantiles
from riskfold.operators import prep as P
from riskfold.operators import split as S


def test_tukey_fences(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(1, 11)], "g int, value double")
    b = P.iqr_bounds(df, ["value"], 1.5).first()
    assert (b.lower, b.upper) == pytest.approx((-3.5, 14.5))
    b3 = P.iqr_bounds(df, ["value"], 3.0).first()
    assert (b3.lower, b3.upper) == pytest.approx((-10.25, 21.25))


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(0, -100.0), (0, None), (0, 5.0), (0, 100.0)], "g int, value double")
    bounds = spark.createDataFrame([(0, "value", -3.5, 14.5)], "g int, column string, lower double, upper double")
    out = [r.value for r in P.iqr_clip(df, bounds, ["value"]).collect()]
    assert out == [-3.5, None, 5.0, 14.5]


@pytest.mark.parametrize("bits", [(20, 36, 52, 64), (2, 9, 30, 64), (64,)])
def test_exact_quantiles_whatever_the_digits_of_a_pass(spark, monkeypatch, bits):
    """One pass with all digits, and passes that open buckets of few digits."""
    monkeypatch.setattr(QN, "BITS", bits)
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), [0.0, -0.0, 1e300, -1e300, 5e-324]])   # a heavy value
    rows = [(int(i % 3), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame([*rows, (0, None), (7, None)], "g int, v double").repartition(5)
    out = exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).collect()
    for r in out:
        expect = np.quantile(np.array([v for g, v in rows if g == r.g]), r.p)
        assert r.q == pytest.approx(expect, abs=1e-12)
    assert len(out) == 18


def test_quantiles_by_text_and_null_groups_and_weights(spark):
    rows = [("a", None, 1.0, 3), ("a", None, 2.0, 1), ("b", 1, 5.0, 2), (None, 1, 9.0, 1), (None, 1, 7.0, 1)]
    df = spark.createDataFrame(rows, "k string, m int, v double, w long")
    got = {(r.k, r.m): r.q for r in exact_quantiles(df, ["k", "m"], "v", [0.5], weight_col="w").collect()}
    assert got == {("a", None): 1.0, ("b", 1): 5.0, (None, 1): 8.0}


def test_fold_complements_equal_copied_rows(spark):
    """Fences, medians of clipped values and category counts as all folds less
    one, against the rows copied into every fit group."""
    rng = np.random.default_rng(8)
    rows = [(str(i), int(f), None if i % 11 == 0 else float(round(v, 1)), float(i % 4), str(rng.integers(0, 3)))
            for i, (f, v) in enumerate(zip(rng.integers(0, 4, 900), rng.standard_cauchy(900)))]
    dev = spark.createDataFrame(rows, "row_id string, fold int, a double, b double, c string")
    folds, train = S.fold_fits(4), S.train_view(dev, 4)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    bounds = P.iqr_bounds(dev, ["a", "b"], 1.5, folds)
    assert key(bounds) == key(P.iqr_bounds(train, ["a", "b"], 1.5).select(*bounds.columns))
    for r in bounds.where("column = 'a'").collect():
        own = [v for _, f, v, _, _ in rows if f != r.g and v is not None]
        assert (r.q1, r.q3) == pytest.approx(tuple(np.quantile(own, [0.25, 0.75])))
    got = P.medians(dev, ["a", "b"], folds, bounds)
    assert key(got) == key(P.medians(P.iqr_clip(train, bounds, ["a", "b"]), ["a", "b"]).select(*got.columns))
    counts = P.category_counts(dev, ["c"], folds)
    assert key(counts) == key(P.category_counts(train, ["c"]).select(*counts.columns))
    assert counts.count() == 15


def test_scaler_uses_population_std(spark):
    rows = [(0, str(i), float(v), "x") for i, v in enumerate([0] * 9 + [90])]
    train = spark.createDataFrame(rows, "g int, row_id string, num double, cat string")
    f = P.fit(train, ["num"], ["cat"])
    test = spark.createDataFrame([(0, "t", 100.0, "never_seen")], "g int, row_id string, num double, cat string")
    vals = {r.feature: r.value for r in P.transform_long(test, f).collect()}
    assert vals["num"] == pytest.approx((100 - 9) / 27)
    assert vals["cat_x"] == 0.0          # unseen category -> all dummies zero


def test_binary_and_mode(spark):
    rows = [(0, str(i), 1.0, v) for i, v in enumerate(["N", "Y", "Y", None, "N", "Y"])]
    train = spark.createDataFrame(rows, "g int, row_id string, num double, flag string")
    f = P.fit(train, ["num"], ["flag"])
    c = f.cat.first()
    assert (c.mode, c.v0, c.v1, c.is_binary, c.fallback) == ("Y", "N", "Y", True, 1)
    new = spark.createDataFrame([(0, "a", 1.0, None), (0, "b", 1.0, "Z"), (0, "c", 1.0, "N")],
                                "g int, row_id string, num double, flag string")
    vals = {r.row_id: r.value for r in P.transform_long(new, f).where("feature = 'flag'").collect()}
    assert vals == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    w = {r.y: r.weight for r in P.class_weights(df, "y").collect()}
    assert w == {0: pytest.approx(0.625), 1: pytest.approx(2.5)}


def test_greedy_prune_rules():
    # 0-1 correlated, 1-2 correlated: dropping 1 (by 0) means 2 survives
    assert P.greedy_prune([0, 1, 2], set(), {(0, 1), (1, 2)}) == {1: "correlated"}
    assert P.greedy_prune([0, 1, 2], {0}, {(0, 1)}) == {0: "low_variance"}


def test_selector_drops_duplicate_and_constant(spark):
    rng = np.random.default_rng(0)
    sig = rng.normal(size=200)
    rows = [(-1, str(i), float(sig[i]), float(sig[i] * 2 + 1e-6 * rng.normal()), float(rng.normal()),
             1.0 if i == 0 else 0.0) for i in range(200)]
    train = spark.createDataFrame(rows, "g int, row_id string, signal double, duplicate double, noise double, "
                                        "constant_like double")
    f = P.fit(train, ["signal", "duplicate", "noise", "constant_like"], [])
    flist = P.global_feature_list(f)
    sel = {r.feature: r.reason for r in P.select_features(f, P.transform_array(train, f, flist), flist).collect()}
    assert sel["duplicate"] == "correlated" and sel["signal"] is None and sel["noise"] is None
    # a standardised rare column keeps unit variance: only exact constants are low-variance here
    assert sel["constant_like"] is None


def test_selection_by_sums_of_categories_equals_that_of_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        a, c = float(rng.normal()), "pqrs"[int(rng.integers(4))]
        rows.append((i % 3, f"r{i}", a, 2 * a + 0.1 * float(rng.normal()), None if i % 7 == 0 else float("pqrs".index(c)), 5.0,
                     None if i % 11 == 0 else c, "xy"[i % 2], "yes" if c == "q" else "no"))
    train = spark.createDataFrame(rows, "g int, row_id string, a double, b double, d double, flat double, c string, two string, same string")
    f = P.fit(train, ("a", "b", "d", "flat"), ("c", "two", "same"), ("a",))
    flist = P.global_feature_list(f)
    x = P.transform_array(train, f, flist)
    by_rows = P.select_features(f, x, flist, 1e-4, 0.8).toPandas()
    # the rows themselves are not read as features: a table without any gives the same
    by_sums = P.select_features(f, x.limit(0), flist, 1e-4, 0.8, rows=train).toPandas()
    keys = ["g", "gpos", "pos", "feature"]
    by_rows, by_sums = (t.sort_values(keys).reset_index(drop=True) for t in (by_rows, by_sums))
    assert {"low_variance", "correlated"} <= set(by_rows.reason.dropna())
    assert (by_rows[[*keys, "kept"]] == by_sums[[*keys, "kept"]]).all().all() and (by_rows.reason.fillna("") == by_sums.reason.fillna("")).all()
    assert np.allclose(by_rows.var_samp, by_sums.var_samp, rtol=1e-9, atol=1e-12)
    assert P.category_sums(train, f, flist).count() <= 3 * 5 * 2 * 2   # groups x combinations, not rows
