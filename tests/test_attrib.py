"""Attribution contracts: additivity (trees and permutation), signal features first."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import attrib as AT
from riskfold.operators import boost as B


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    y = (2 * x[:, 0] + 0.6 * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [(0, f"r{i}", int(y[i]), 1.0, [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, row_id string, y int, w0 double, x array<double>") \
        .withColumn("h", F.xxhash64("row_id"))
    cuts, trees = B.fit_trees(df, 5, trees=3, rate=0.3, depth=3, subsample=1.0, colsample=1.0)
    scuts, stumps = B.fit_stumps(df, 5, rounds=6, rate=0.5)
    return df, x, cuts, trees, scuts, stumps


def _sum_phi(phi_df):
    pdf = phi_df.toPandas()
    s = pdf.groupby("row_id").agg(phi=("phi", "sum"), base=("base", "first"))
    return s["phi"] + s["base"]


def test_tree_attributions_add_up(spark, fitted):
    df, x, cuts, trees, *_ = fitted
    sample = df.limit(40)
    total = _sum_phi(AT.tree_attributions(sample, cuts, trees, 5))
    margin = B.score_rows(sample, cuts, trees, "trees").toPandas().set_index("row_id")["margin"]
    assert np.allclose(total.sort_index(), margin.sort_index(), atol=1e-9)


def test_interventional_add_up_and_depend_on_background(spark, fitted):
    df, x, cuts, trees, *_ = fitted
    sample = df.limit(20)
    bg1, bg2 = {0: x[:10]}, {0: x[200:210] + 1.0}
    p1 = AT.tree_attributions(sample, cuts, trees, 5, background=bg1)
    p2 = AT.tree_attributions(sample, cuts, trees, 5, background=bg2)
    margin = B.score_rows(sample, cuts, trees, "trees").toPandas().set_index("row_id")["margin"]
    assert np.allclose(_sum_phi(p1).sort_index(), margin.sort_index(), atol=1e-9)
    a = p1.toPandas().sort_values(["row_id", "j"])["phi"].to_numpy()
    b = p2.toPandas().sort_values(["row_id", "j"])["phi"].to_numpy()
    assert not np.allclose(a, b)


def test_permutation_telescopes_and_ranks_signal(spark, fitted):
    df, x, _, _, scuts, stumps = fitted
    sample = df.limit(30)
    bg = {0: x[100:120]}
    phi = AT.permutation_attributions(sample, scuts, stumps, 5, bg)
    total = _sum_phi(phi)
    prob = B.score_rows(sample, scuts, stumps, "stumps").toPandas().set_index("row_id")["score"]
    assert np.allclose(total.sort_index(), prob.sort_index(), atol=1e-9)
    names = spark.createDataFrame([(j, f"f{j}") for j in range(5)], "j int, feature string")
    top = AT.importance(phi, names).orderBy("rank").first()
    assert top.feature == "f0"


def _subset_phi(o, z, v):
    """Shapley values of one leaf by all subsets."""
    u, out = len(o), []
    for i in range(u):
        others, acc = [j for j in range(u) if j != i], 0.0
        for r in range(u):
            for s in itertools.combinations(others, r):
                acc += math.factorial(r) * math.factorial(u - r - 1) / math.factorial(u) * math.prod(o[j] if j in s else z[j] for j in others)
        out.append(v * (o[i] - z[i]) * acc)
    return out


@pytest.mark.parametrize("u", [1, 2, 5, 9])
def test_path_recursion_equals_the_sum_over_subsets(u):
    rng = np.random.default_rng(u)
    cons = {j: (int(lo), int(lo) + 8, float(z)) for j, (lo, z) in enumerate(zip(rng.integers(0, 20, u), rng.choice([0.0, 0.2, 0.7, 1.0], u)))}
    bins = rng.integers(0, 32, (40, u))
    phi, _ = AT.tree_phi(bins, [[(1.7, cons)]], u)
    for row, got in zip(bins, phi):
        o = [float(lo <= b <= hi) for b, (lo, hi, _) in zip(row, cons.values())]
        assert np.allclose(got, _subset_phi(o, [z for *_, z in cons.values()], 1.7), atol=1e-9)


def test_background_patterns_equal_row_by_row():
    rng = np.random.default_rng(3)
    cons = {j: (int(lo), int(lo) + 14, 0.5) for j, lo in enumerate(rng.integers(0, 16, 6))}
    bins, bg = rng.integers(0, 32, (60, 6)), rng.integers(0, 32, (35, 6))
    phi, base = AT.tree_phi(bins, [[(-0.9, cons)]], 6, bg)
    inside = lambda rows: np.array([[float(lo <= b <= hi) for b, (lo, hi, _) in zip(r, cons.values())] for r in rows])
    for row, got in zip(inside(bins), phi):
        assert np.allclose(got, np.mean([_subset_phi(row, z, -0.9) for z in inside(bg)], axis=0), atol=1e-9)
    assert np.allclose(base, -0.9 * inside(bg).all(1).mean())


def test_a_path_of_twelve_features_is_quick():
    cons = {j: (4, 27, 0.6) for j in range(12)}
    bins = np.random.default_rng(1).integers(0, 32, (2000, 12))
    phi, base = AT.tree_phi(bins, [[(1.0, cons)]] * 20, 12)
    reached = ((bins >= 4) & (bins <= 27)).all(1)
    assert np.allclose(phi.sum(1) + base, 20.0 * reached, atol=1e-9)


def test_permutation_terms_equal_rescoring_every_step():
    rng = np.random.default_rng(5)
    stumps = [(int(j), int(b), int(s), float(a)) for j, b, s, a in zip(rng.integers(0, 4, 30), rng.integers(0, 31, 30), rng.choice([-1, 1], 30), rng.random(30))]
    bins, bg, order = rng.integers(0, 32, (15, 5)), rng.integers(0, 32, (7, 5)), rng.permutation(5)
    phi, base = AT.permutation_phi(bins, bg, stumps, 5, order)

    def prob(x):
        f = sum(a * np.where(x[:, j] <= b, s, -s) for j, b, s, a in stumps)
        return 1 / (1 + np.exp(-2 * f / sum(a for *_, a in stumps)))

    want = np.zeros((15, 5))
    for way in (order, order[::-1]):
        for r, row in enumerate(bins):
            cur = bg.copy()
            for j in way:
                was = prob(cur).mean()
                cur[:, j] = row[j]
                want[r, j] += (prob(cur).mean() - was) / 2
    assert np.allclose(phi, want, atol=1e-9) and np.allclose(base, prob(bg).mean())


def test_importance_leaves_out_features_that_the_selector_dropped(spark):
    phi = spark.createDataFrame([(0, "a", 0, 0.5, 0.0), (0, "a", 1, 0.0, 0.0), (0, "a", 2, -0.1, 0.0), (1, "b", 1, 0.3, 0.0)], AT.PHI_SCHEMA)
    names = spark.createDataFrame([(j, f"f{j}") for j in range(3)], "j int, feature string")
    kept = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "g int, j int")
    got = {(r.g, r.feature, r["rank"]) for r in AT.importance(phi, names, kept).collect()}
    assert got == {(0, "f0", 1), (0, "f2", 2), (1, "f1", 1)}


def test_tabled_leaves_equal_the_walk_over_rows():
    """The table of patterns gives what each row's own passes give, with and without a background."""
    rng = np.random.default_rng(8)
    bins, bg = rng.integers(0, 32, (300, 7)), rng.integers(0, 32, (40, 7))
    cons = {j: (int(lo), int(lo) + 14, float(z)) for j, lo, z in zip((5, 0, 3, 6), rng.integers(0, 16, 4), (0.4, 0.0, 1.0, 0.7))}
    for back in (None, bg):
        phi, base = AT.tree_phi(bins, [[(0.8, cons), (-0.3, {2: (0, 9, 0.5)})]], 7, back)
        own, whole = np.zeros((300, 7)), 0.0
        for v, c in ((0.8, cons), (-0.3, {2: (0, 9, 0.5)})):
            if back is None:
                AT._path_leaf(v, c, AT._passes(bins, c), own)
                whole += v * math.prod(z for _, _, z in c.values())
            else:
                whole += AT._background_leaf(v, c, AT._passes(bins, c), AT._passes(bg, c), own)
        assert np.allclose(phi, own, atol=1e-13) and np.allclose(base, whole)


def test_values_travel_with_the_attributions(spark, fitted):
    df, x, cuts, trees, scuts, stumps = fitted
    sample = df.where(F.expr("cast(substring(row_id, 2) as int) % 11 = 0"))
    for whole, some in ((AT.tree_attributions(sample, cuts, trees, 5), AT.tree_attributions(sample, cuts, trees, 5, values=[3, 1])),
                        (AT.permutation_attributions(sample, scuts, stumps, 5, {0: x[:9]}), AT.permutation_attributions(sample, scuts, stumps, 5, {0: x[:9]}, values=[3, 1]))):
        want = {(r.row_id, r.j): r.phi for r in whole.collect() if r.j in (1, 3)}
        got = some.collect()
        assert {(r.row_id, r.j): r.phi for r in got} == want and len(got) == len(want)
        assert all(r.value == x[int(r.row_id[1:]), r.j] for r in got)
