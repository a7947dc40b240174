"""Packed codes give every feature's histogram; a model is the same with and without blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.functions.packs import Packs, leaf_bits
from riskfold.operators import boost as B


def _rows(n=500, seed=3):
    rng = np.random.default_rng(seed)
    numeric = rng.normal(size=(n, 3))
    dummies = np.eye(25)[rng.integers(0, 25, n)] * (rng.random(n) > 0.1)[:, None]
    x = np.hstack([numeric, dummies])
    return x, [list(range(3, 28))], rng


def test_packed_histograms_equal_those_of_each_feature():
    x, blocks, rng = _rows()
    cuts = np.array([np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower") for c in x.T])
    packs = Packs(cuts, 32, blocks)
    assert len(packs.sizes) <= 3                       # 28 features are counted by three codes
    codes, bins = packs.encode(x), B._bins(x, cuts)
    assert all((packs.table(j)[codes[packs.place[j][0]]] == bins[:, j]).all() for j in range(28))
    weight = rng.integers(-9, 9, len(x)).astype(float)
    sums = packs.apart([packs.count(k, codes[k], (weight, None)) for k in range(len(packs.sizes))])[:, 0]
    for j in range(28):
        assert (sums[0, j] == np.bincount(bins[:, j], weight, 32)).all() and (sums[1, j] == np.bincount(bins[:, j], minlength=32)).all()


def test_a_block_with_two_features_in_a_row_is_refused():
    x, blocks, _ = _rows()
    x[0, 3:5] = 1.0
    packs = Packs(np.tile(np.linspace(0, 0.9, 31), (28, 1)), 32, blocks)
    with pytest.raises(ValueError):
        packs.encode(x)


def test_models_with_blocks_equal_those_without(spark):
    x, blocks, rng = _rows(400)
    y = (x[:, 0] + x[:, 5] + x[:, 9] + 0.2 * rng.normal(size=400) > 0.1).astype(int)
    df = spark.createDataFrame([(0, f"r{i}", int(y[i]), 1.0, x[i].tolist()) for i in range(400)], "g int, row_id string, y int, w0 double, x array<double>")
    df = df.withColumn("h", F.xxhash64("row_id"))
    specs = {"s": ("stumps", dict(rounds=5, rate=0.5)), "l": ("trees", dict(trees=3, rate=0.3, depth=5, leaves=6, min_child_weight=0.1))}
    made = [B.fit_many(df, 28, specs, blocks=b, task_cells=c) for b, c in (((), B.TASK_CELLS), (blocks, B.TASK_CELLS), (blocks, 0))]
    for other in made[1:]:
        assert other["s"][1] == made[0]["s"][1]
        assert all(np.array_equal(a, b) for s, t in zip(made[0]["l"][1][0], other["l"][1][0]) for a, b in zip(s.arrays(), t.arrays()))


def _grown(rng, p, bins, leaves):
    tree, open_ = B.Tree(), [0]
    for _ in range(leaves - 1):
        open_ += tree.split(open_.pop(int(rng.integers(len(open_)))), int(rng.integers(p)), int(rng.integers(bins - 1)), 1.0)
    tree.value = [float(v) for v in rng.normal(size=len(tree.feat))]
    return tree


@pytest.mark.parametrize("leaves", [1, 2, 16, 32, 33, 64, 65])
def test_leaves_as_bits_are_the_leaves_that_rows_reach(leaves):
    x, blocks, rng = _rows()
    cuts = np.array([np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower") for c in x.T])
    packs, trees = Packs(cuts, 32, blocks), [_grown(rng, 28, 32, leaves) for _ in range(6)]
    bins, direct = B._bins(x, cuts), np.zeros(len(x))
    for t in trees:
        direct += t.arrays()[4][B._route(bins, t.arrays())]
    assert (packs.margin(packs.encode(x), [leaf_bits(t.arrays(), 32) for t in trees]) == direct).all()


def test_metrics_of_all_models_score_a_row_once(spark, monkeypatch):
    from riskfold import catalog as C
    from riskfold.plans.experiments import FittedModels, Matrices
    x, blocks, rng = _rows(240)
    y = (x[:, 0] + 0.3 * rng.normal(size=len(x)) > 0).astype(int)
    rows = [(g, f"r{i}", int(y[i]), x[i].tolist()) for i in range(len(x)) for g in [i % 3 - 1]]
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    apply = spark.createDataFrame(rows, "g int, row_id string, y int, x array<double>").mapInArrow(counted, "g int, row_id string, y int, x array<double>")
    cuts = {g: np.array([np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower") for c in x.T]) for g in (-1, 0, 1)}
    trees = {g: [_grown(rng, 28, 32, 8) for _ in range(3)] for g in cuts}
    models = {"adaboost": ("stumps", cuts, {g: [(0, 9, -1, 0.5), (1, 4, 1, 0.25)] for g in cuts}), "xgboost": ("trees", cuts, trees), "lightgbm": ("trees", cuts, trees)}
    monkeypatch.setattr(C, "_mats", lambda spark, sf: Matrices(None, apply, 28, [], {}, blocks))
    monkeypatch.setattr(C, "_all_models", lambda spark, sf: FittedModels(models, {k: 0.0 for k in models}))
    assert C.REGISTRY["cv_fold_metrics"].fn(spark, "").count() == 6
    assert passes.value == len(rows)                   # three models, sizes, curves and thresholds: one reading
    assert "MapInArrow" not in C._held_scores(spark, "")._jdf.queryExecution().executedPlan().toString()
