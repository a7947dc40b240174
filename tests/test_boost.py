"""Boosting learns a planted signal; models are deterministic; leaf-wise keeps n leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import boost as B
from riskfold.operators import metrics as M


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5))
    y = (2 * x[:, 0] + 0.6 * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    rows = [(g, f"r{i}", int(y[i]), 1.0, [float(v) for v in x[i]]) for g in (-1, 0) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, row_id string, y int, w0 double, x array<double>")
    return df.withColumn("h", F.xxhash64("row_id"))


def _auc(spark, scores):
    sc = scores.withColumn("fold", F.col("g"))
    return {r.g: r.roc_auc for r in M.auc_metrics(M.score_counts(sc, ["g"]), ["g"]).collect()}


def test_stumps_learn_and_are_deterministic(spark, planted):
    cuts, model = B.fit_stumps(planted, 5, rounds=8, rate=0.5)
    _, again = B.fit_stumps(planted, 5, rounds=8, rate=0.5)
    assert model == again
    assert model[-1][0][0] == 0                       # first stump on the strongest feature
    auc = _auc(spark, B.score_rows(planted, cuts, model, "stumps"))
    assert auc[-1] > 0.85


def test_trees_learn_and_leafwise_cap(spark, planted):
    cuts, model = B.fit_trees(planted, 5, trees=4, rate=0.3, depth=3, subsample=1.0, colsample=1.0)
    auc = _auc(spark, B.score_rows(planted, cuts, model, "trees"))
    assert auc[-1] > 0.9 and auc[0] > 0.9
    cuts2, leafy = B.fit_trees(planted, 5, trees=2, rate=0.3, depth=4, leaves=5, subsample=1.0, colsample=1.0)
    for tr in leafy[-1]:
        assert sum(1 for f in tr.feat if f < 0) <= 5


def test_best_first_selection_order():
    t = B.Tree()
    a, b = t.split(0, 0, 1, 10.0)
    t.split(a, 1, 1, 1.0)
    t.split(b, 2, 1, 5.0)
    kept = B._best_first(t, 3)
    assert sum(1 for f in kept.feat if f < 0) == 3
    assert 2 in kept.feat and 1 not in kept.feat      # the higher-gain child split is made first


def test_shared_passes_equal_separate_fits(planted):
    """Models trained together (one histogram job per step for all of them)
    equal the same models trained alone."""
    both = B.fit_many(planted, 5, {"s": ("stumps", dict(rounds=4, rate=0.5)),
                                   "t": ("trees", dict(trees=2, rate=0.3, depth=3, subsample=0.8, colsample=0.8))})
    _, stumps = B.fit_stumps(planted, 5, rounds=4, rate=0.5)
    _, trees = B.fit_trees(planted, 5, trees=2, rate=0.3, depth=3, subsample=0.8, colsample=0.8)
    assert both["s"][1] == stumps
    for g, lst in trees.items():
        for a, b in zip(lst, both["t"][1][g]):
            assert a.feat == b.feat and a.thr == b.thr
            assert np.allclose(a.value, b.value, rtol=1e-12, atol=1e-15)


def test_leaf_values_equal_a_pass_over_rows(planted):
    """Leaf values taken from the parent's histogram equal -G/(H+lambda)*rate
    summed directly over each leaf's rows."""
    cuts, model = B.fit_trees(planted, 5, trees=1, rate=0.3, depth=3, subsample=1.0, colsample=1.0)
    pdf = planted.where("g = -1").toPandas()
    bins = B._bins(np.vstack(pdf["x"].to_numpy()), cuts[-1])
    tr = model[-1][0]
    leaf = B._route(bins, tr.arrays())
    p, y = 0.5, pdf["y"].to_numpy()
    for nd in np.unique(leaf):
        m = leaf == nd
        G, H = float(np.sum(p - y[m])), float(np.sum(np.full(m.sum(), p * (1 - p))))
        assert abs(tr.value[nd] - (-G / (H + 1.0) * 0.3)) < 1e-9


def test_cuts_and_models_do_not_depend_on_the_partitioning(planted):
    """The same sketch, stumps and trees from 1, 4 and 211 partitions."""
    specs = {"s": ("stumps", dict(rounds=5, rate=0.5)), "t": ("trees", dict(trees=2, rate=0.3, depth=3)), "l": ("trees", dict(trees=2, rate=0.3, depth=4, leaves=6))}
    found = []
    for parts in (1, 4, 211):
        made = B.fit_many(planted.repartition(parts, "row_id"), 5, specs, task_cells=0 if parts != 4 else B.TASK_CELLS)
        found.append(({g: c.tolist() for g, c in made["s"][0].items()}, made["s"][1],
                      {k: {g: [t.arrays() for t in v] for g, v in made[k][1].items()} for k in ("t", "l")}))
    for other in found[1:]:
        assert other[:2] == found[0][:2]
        for k in ("t", "l"):
            for g, trees in found[0][2][k].items():
                assert all(np.array_equal(a, b) for x, y in zip(trees, other[2][k][g]) for a, b in zip(x, y))


def test_state_partitions_exchange_the_same_histograms(planted, monkeypatch):
    """Several state partitions, tiles of two features and a state written
    every second cycle give the model of one partition."""
    specs = {"t": ("trees", dict(trees=5, rate=0.3, depth=3)), "s": ("stumps", dict(rounds=7, rate=0.5))}
    one = B.fit_many(planted, 5, specs)   # grown by tasks that hold a group each
    monkeypatch.setattr(B, "PART_ROWS", 200)
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "TILE", 2)
    monkeypatch.setattr(B, "KEEP", 2)
    monkeypatch.setattr(B, "TASK_BYTES", 20_000)
    many = B.fit_many(planted.repartition(6), 5, specs, task_cells=0)
    assert many["s"][1] == one["s"][1]
    for g, trees in one["t"][1].items():
        for a, b in zip(trees, many["t"][1][g]):
            assert all(np.array_equal(x, y) for x, y in zip(a.arrays(), b.arrays()))


def test_cost_is_linear_and_old_states_are_deleted(spark, planted):
    import glob
    seen = []
    folder = B.ensure_checkpoint_dir(spark).removeprefix("file:")
    B.fit_many(planted, 5, {"t": ("trees", dict(trees=4, rate=0.3, depth=2)), "s": ("stumps", dict(rounds=8, rate=0.5))},
               watch=lambda p: seen.append((p.count, len(glob.glob(f"{folder}/boost-state-*")))))
    assert [n for n, _ in seen] == [2, 4, 6, 8]          # a pass a level, whatever has been grown before
    assert max(n for _, n in seen) == 1 and not glob.glob(f"{folder}/boost-state-*")


def test_trees_equal_a_direct_fit(planted):
    """Depth-wise trees with hessian histograms written out in numpy."""
    cuts, model = B.fit_trees(planted, 5, trees=3, rate=0.3, depth=2, subsample=1.0, colsample=1.0)
    pdf = planted.where("g = 0").toPandas()
    bins = B._bins(np.vstack(pdf["x"].to_numpy()), cuts[0])
    y, margin = pdf["y"].to_numpy(), np.zeros(len(pdf))

    def best(at, p):
        gr, he, top = p[at] - y[at], p[at] * (1 - p[at]), None
        for j in range(5):
            for b in range(31):
                left = bins[at, j] <= b
                gl, hl = gr[left].sum(), he[left].sum()
                gr_, hr = gr.sum() - gl, he.sum() - hl
                if hl < 1 or hr < 1:
                    continue
                gain = gl ** 2 / (hl + 1) + gr_ ** 2 / (hr + 1) - gr.sum() ** 2 / (he.sum() + 1)
                if gain > 1e-12 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, j, b)
        return top

    for tree in model[0]:
        p = 1 / (1 + np.exp(-margin))
        gain, j, b = best(np.arange(len(y)), p)
        assert (tree.feat[0], tree.thr[0]) == (j, b) and abs(tree.gain[0] - gain) < 1e-6
        for side, node in ((bins[:, j] <= b, tree.left[0]), (bins[:, j] > b, tree.right[0])):
            sub = best(np.flatnonzero(side), p)
            assert (tree.feat[node], tree.thr[node]) == (sub[1], sub[2])
        margin = margin + B._value(bins, tree.arrays())


def test_only_kept_features_are_split_on(planted):
    made = B.fit_many(planted, 5, {"t": ("trees", dict(trees=3, rate=0.3, depth=3)), "s": ("stumps", dict(rounds=4, rate=0.5))}, columns={-1: [1, 2], 0: [3]})
    assert {f for t in made["t"][1][-1] for f in t.feat if f >= 0} <= {1, 2}
    assert {f for t in made["t"][1][0] for f in t.feat if f >= 0} <= {3} and {j for j, *_ in made["s"][1][0]} == {3}
