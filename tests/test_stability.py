"""Rank stability on small importance frames."""

import pytest

from riskfold.operators import stability as ST


def _imp(spark, folds):
    rows = []
    for fold, order in folds.items():
        for rank, feat in enumerate(order, start=1):
            rows.append(("d", "D", "m", "M", fold, feat, float(10 - rank), rank))
    return spark.createDataFrame(rows, "dataset_key string, dataset_name string, model_key string, "
                                       "model_name string, fold int, feature string, mean_abs_shap double, rank int")


def test_identical_and_reversed(spark):
    imp = _imp(spark, {1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["c", "b", "a"]})
    pw = {(r.fold_a, r.fold_b): r for r in ST.pairwise_stability(imp, 2).collect()}
    assert pw[(1, 2)].spearman_rho == pytest.approx(1.0) and pw[(1, 2)].kendall_tau == pytest.approx(1.0)
    assert pw[(1, 3)].spearman_rho == pytest.approx(-1.0) and pw[(1, 3)].kendall_tau == pytest.approx(-1.0)
    assert pw[(1, 3)].top_k_jaccard == pytest.approx(1 / 3)
    s = ST.stability_summary(ST.pairwise_stability(imp, 2)).first()
    assert s.pair_count == 3 and s.n_folds == 3


def test_ranking_overlap_values(spark):
    imp = _imp(spark, {1: ["a", "b", "c", "d"], 2: ["a", "b", "d", "c"], 3: ["d", "c", "b", "a"]})
    ov = {(r.fold_a, r.fold_b): r for r in ST.ranking_overlap(ST.ranking_lists(imp), 2).collect()}
    assert ov[(1, 2)].spearman == pytest.approx(0.8) and ov[(1, 2)].overlap == pytest.approx(1.0)
    assert ov[(1, 3)].spearman == pytest.approx(-1.0) and ov[(1, 3)].overlap == pytest.approx(0.0)


def test_consensus(spark):
    imp = _imp(spark, {1: ["a", "b"], 2: ["b", "a"]})
    c = {r.feature: r for r in ST.consensus_ranking(imp, 1).collect()}
    assert c["a"].mean_rank == 1.5 and c["a"].consensus_rank == 1 and c["b"].consensus_rank == 2
    assert c["a"].top_k_frequency == 0.5
