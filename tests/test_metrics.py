"""Hand-computed metric cases and published fold summaries."""

import pytest
from pyspark.sql import functions as F

from riskfold.operators import metrics as M


def _scores(spark, y, s):
    rows = [("d", "D", "m", "M", 0, str(i), yi, float(si)) for i, (yi, si) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "dataset_key string, dataset_name string, model_key string, "
                                       "model_name string, fold int, row_id string, y int, score double")


def test_hand_metrics(spark):
    sc = _scores(spark, [0, 0, 1, 1, 0, 1], [.1, .4, .35, .8, .65, .9])
    r = M.binary_metrics(sc, ["fold"], 0.5).first()
    assert r.roc_auc == pytest.approx(7 / 9)
    assert r.pr_auc == pytest.approx(0.85)
    assert r.recall == pytest.approx(2 / 3)
    assert r.f1 == pytest.approx(2 / 3)


def test_perfect_and_constant(spark):
    perfect = M.binary_metrics(_scores(spark, [0, 0, 1, 1], [.1, .2, .8, .9]), ["fold"]).first()
    assert perfect.roc_auc == pytest.approx(1.0) and perfect.pr_auc == pytest.approx(1.0)
    const = M.binary_metrics(_scores(spark, [0, 1, 0, 1], [.3, .3, .3, .3]), ["fold"]).first()
    assert const.roc_auc == pytest.approx(0.5)
    assert const.pr_auc == pytest.approx(0.75)   # trapezoid from (0, 1) to (1, 0.5)
    assert const.recall == 0.0 and const.f1 == 0.0


def test_one_class_gives_null_and_guard(spark):
    sc = _scores(spark, [1, 1, 1], [.2, .5, .9])
    assert M.auc_metrics(M.score_counts(sc, ["fold"]), ["fold"]).first().roc_auc is None
    assert M.metric_guards(sc, ["fold"]).first().ok is False


def test_bucketed_running_counts_match_window(spark):
    # many distinct scores inside one bucket and across buckets
    import random
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(400)]
    s = [round(rnd.random(), 3) for _ in range(400)]
    sc = _scores(spark, y, s)
    r = M.binary_metrics(sc, ["fold"]).first()
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert r.roc_auc == pytest.approx(auc)


# published fold rows of one dataset/model and its published summary (golden values)
FOLD_ROWS = [
    (1, 0.9276735459662289, 0.9400497897793847, 0.8292682926829268, 0.85),
    (2, 0.8524130190796858, 0.8540309284333576, 0.8765432098765432, 0.8452380952380952),
    (3, 0.9410774410774411, 0.9327237408179823, 0.8024691358024691, 0.8441558441558441),
    (4, 0.9672652450430228, 0.9726245480806421, 0.8518518518518519, 0.8789808917197452),
    (5, 0.9315289648622982, 0.9143630085319431, 0.8641975308641975, 0.875),
]
SUMMARY = {"roc_auc_mean": 0.9239916432057352, "roc_auc_std": 0.04289054721717646,
           "pr_auc_mean": 0.922758403128662, "pr_auc_std": 0.043814611855998456,
           "recall_mean": 0.8448660042155977, "recall_std": 0.02943950748800357,
           "f1_mean": 0.8586749662227369, "f1_std": 0.016922224916775128, "roc_auc_range": 0.114852225963337}


def test_cv_summary_golden(spark):
    rows = [("dataset2", "Heart Failure Prediction", "adaboost", "AdaBoost") + r for r in FOLD_ROWS]
    fm = spark.createDataFrame(rows, "dataset_key string, dataset_name string, model_key string, model_name string, "
                                     "fold int, roc_auc double, pr_auc double, recall double, f1 double")
    s = M.cv_summary(fm).first().asDict()
    for k, v in SUMMARY.items():
        assert s[k] == pytest.approx(v, abs=1e-15)


def test_ranks_and_overall(spark):
    rows = [("a", "A", "m1", "M1", 0.9, 0.5, 0.7, 0.1), ("a", "A", "m2", "M2", 0.8, 0.6, 0.7, 0.1),
            ("b", "B", "m1", "M1", 0.9, 0.7, 0.7, 0.1), ("b", "B", "m2", "M2", 0.8, 0.6, 0.7, 0.1)]
    s = spark.createDataFrame(rows, "dataset_key string, dataset_name string, model_key string, model_name string, "
                                    "roc_auc_mean double, pr_auc_mean double, f1_mean double, pr_auc_std double")
    r = {(x.dataset_key, x.model_key): x.cv_rank for x in M.dataset_ranks(s).collect()}
    assert r == {("a", "m2"): 1, ("a", "m1"): 2, ("b", "m1"): 1, ("b", "m2"): 2}
    with pytest.raises(ValueError):
        M.dataset_ranks(s, "accuracy")
    ranked = M.dataset_ranks(s).withColumn("recall_mean", F.lit(0.0)).withColumn("roc_auc_std", F.lit(0.0)) \
        .withColumn("recall_std", F.lit(0.0)).withColumn("f1_std", F.lit(0.0))
    o = {x.model_key: x.mean_dataset_rank for x in M.overall_comparison(ranked).collect()}
    assert o == {"m1": 1.5, "m2": 1.5}
