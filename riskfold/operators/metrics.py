"""Ranking and threshold metrics per group, fold summaries and model ranks.

ROC-AUC (ties averaged) and PR-AUC (trapezoid from recall 0 / precision 1)
need, for each distinct score, the positives and negatives ranked above it.
Scores are collapsed to distinct values per group (map-side combine), cut
into order-preserving buckets, and the running counts are "rows in higher
buckets" (a running sum over a groups x buckets table) plus "rows higher in
the same bucket" (a window per (group, bucket)).  No window ever spans a
whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("roc_auc", "pr_auc", "recall", "f1")
#: Buckets per doubling of the odds.
ODDS_BUCKETS = 256


def _score_bucket(score: Column, buckets: int) -> Column:
    """Order-preserving bucket by the odds of the score: as fine among the
    small scores of a rare event as in the middle.  Scores outside (0, 1) fall
    in a bucket at either end."""
    odds = F.floor(F.log2(score / (1 - score)) * buckets)
    return F.when(score <= 0, F.lit(-(1 << 40))).when(score >= 1, F.lit(1 << 40)).otherwise(odds).cast("long")


def score_counts(scores: DataFrame, by: list[str], score: str = "score", y: str = "y",
                 buckets: int = ODDS_BUCKETS) -> DataFrame:
    """(by..., score, pos, neg, tp_before, fp_before, n_pos, n_neg): counts of
    positives/negatives with a strictly higher score."""
    d = scores.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(y)).cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(y))).cast("long").alias("neg"))
    d = d.withColumn("_b", _score_bucket(F.col("score").cast("double"), buckets))
    bt = d.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    alls = Window.partitionBy(*by)
    bt = bt.select(*by, "_b",
                   F.coalesce(F.sum("_bp").over(higher), F.lit(0)).alias("_ap"),
                   F.coalesce(F.sum("_bn").over(higher), F.lit(0)).alias("_an"),
                   F.sum("_bp").over(alls).alias("n_pos"), F.sum("_bn").over(alls).alias("n_neg"))
    within = Window.partitionBy(*by, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_wp", F.coalesce(F.sum("pos").over(within), F.lit(0))) \
         .withColumn("_wn", F.coalesce(F.sum("neg").over(within), F.lit(0)))
    j = d.join(bt, [*by, "_b"])
    return j.select(*by, "score", "pos", "neg",
                    (F.col("_ap") + F.col("_wp")).alias("tp_before"),
                    (F.col("_an") + F.col("_wn")).alias("fp_before"), "n_pos", "n_neg")


def auc_metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., roc_auc, pr_auc); NULL when a class is absent."""
    tp = F.col("tp_before") + F.col("pos")
    fp = F.col("fp_before") + F.col("neg")
    prec = tp / (tp + fp)
    prev = F.when((F.col("tp_before") + F.col("fp_before")) == 0, F.lit(1.0)) \
            .otherwise(F.col("tp_before") / (F.col("tp_before") + F.col("fp_before")))
    roc_part = F.col("neg") * (F.col("tp_before") + F.col("pos") / 2.0)
    pr_part = F.col("pos") * (prec + prev) / 2.0
    agg = counts.groupBy(*by).agg(F.sum(roc_part).alias("_roc"), F.sum(pr_part).alias("_pr"),
                                  F.max("n_pos").alias("_p"), F.max("n_neg").alias("_n"))
    ok = (F.col("_p") > 0) & (F.col("_n") > 0)
    return agg.select(*by, F.when(ok, F.col("_roc") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
                      F.when(ok, F.col("_pr") / F.col("_p")).alias("pr_auc"))


def threshold_metrics(scores: DataFrame, by: list[str], threshold: float = 0.5, score: str = "score",
                      y: str = "y") -> DataFrame:
    """(by..., recall, f1) at ``score >= threshold``; 0 when undefined."""
    pred = F.col(score) >= F.lit(threshold)
    agg = scores.groupBy(*by).agg(
        F.sum(F.when(pred & (F.col(y) == 1), 1).otherwise(0)).alias("_tp"),
        F.sum(F.when(pred & (F.col(y) == 0), 1).otherwise(0)).alias("_fp"),
        F.sum(F.when(~pred & (F.col(y) == 1), 1).otherwise(0)).alias("_fn"))
    return agg.select(
        *by,
        F.coalesce(F.try_divide(F.col("_tp"), (F.col("_tp") + F.col("_fn")).cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("_tp"), (2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).cast("double")),
                   F.lit(0.0)).alias("f1"))


def binary_metrics(scores: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by..., roc_auc, pr_auc, recall, f1)."""
    return auc_metrics(score_counts(scores, by), by).join(threshold_metrics(scores, by, threshold), by)


def metric_guards(scores: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """(by..., n, n_pos, n_neg, n_bad_label, n_bad_score, ok): both classes are
    required, labels are 0 or 1, scores are numbers."""
    bad_label = ~F.coalesce(F.col(y).isin(0, 1), F.lit(False))
    bad_score = F.col("score").isNull() | F.isnan("score")
    agg = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"),
        F.count_if(bad_label).alias("n_bad_label"), F.count_if(bad_score).alias("n_bad_score"))
    return agg.withColumn("ok", (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_bad_label") == 0) & (F.col("n_bad_score") == 0))


def roc_points(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., threshold, fpr, tpr) at each distinct score, plus (0, 0)."""
    pts = counts.select(*by, F.col("score").alias("threshold"),
                        ((F.col("fp_before") + F.col("neg")) / F.col("n_neg")).alias("fpr"),
                        ((F.col("tp_before") + F.col("pos")) / F.col("n_pos")).alias("tpr"))
    origin = counts.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


KEYS = ["dataset_key", "dataset_name", "model_key", "model_name"]


def fold_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per (dataset, model, fold): sizes, positive rates, metrics.
    Training counts of a fold are the development totals minus the fold."""
    by = [*KEYS, "fold"]
    sizes = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_validation"),
                                    F.sum("y").cast("long").alias("_vp"))
    tot = Window.partitionBy(*KEYS)
    sizes = (sizes.withColumn("_n", F.sum("n_validation").over(tot)).withColumn("_p", F.sum("_vp").over(tot))
                  .select(*by, (F.col("_n") - F.col("n_validation")).alias("n_train"), "n_validation",
                          ((F.col("_p") - F.col("_vp")) / (F.col("_n") - F.col("n_validation"))).alias("train_positive_rate"),
                          (F.col("_vp") / F.col("n_validation")).alias("validation_positive_rate")))
    return sizes.join(binary_metrics(scores, by, threshold), by)


def cv_summary(folds: DataFrame, metrics=METRICS) -> DataFrame:
    """mean, sample std, min, max, range of each metric per (dataset, model)."""
    missing = set(KEYS + list(metrics)) - set(folds.columns)
    if missing:
        raise ValueError(f"the fold rows lack {', '.join(sorted(missing))}")
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    s = folds.groupBy(*KEYS).agg(*aggs)
    for m in metrics:
        s = s.withColumn(f"{m}_range", F.col(f"{m}_max") - F.col(f"{m}_min"))
    return s


def dataset_ranks(summary: DataFrame, primary: str = "pr_auc") -> DataFrame:
    """cv_rank 1..n inside each dataset: primary mean desc, ROC mean desc,
    F1 mean desc, primary std asc (model key last, for a total order)."""
    if primary not in METRICS:
        raise ValueError(f"{primary!r} is none of {', '.join(METRICS)}")
    w = Window.partitionBy("dataset_key").orderBy(
        F.desc(f"{primary}_mean"), F.desc("roc_auc_mean"), F.desc("f1_mean"), F.asc(f"{primary}_std"),
        F.asc("model_key"))
    return summary.withColumn("cv_rank", F.row_number().over(w))


def overall_comparison(ranked: DataFrame, metrics=METRICS) -> DataFrame:
    """Per model: mean within-dataset rank, unweighted means of means and stds."""
    aggs = [F.avg("cv_rank").alias("mean_dataset_rank")]
    aggs += [F.avg(f"{m}_mean").alias(f"{m}_mean") for m in metrics]
    aggs += [F.avg(f"{m}_std").alias(f"{m}_std") for m in metrics]
    return ranked.groupBy("model_key", "model_name").agg(*aggs)


def model_comparison(ranked: DataFrame, test: DataFrame, metrics=METRICS) -> DataFrame:
    """CV summary with rank, left-joined with hold-out metrics as test_*."""
    t = test.select("dataset_key", "model_key", *[F.col(m).alias(f"test_{m}") for m in metrics])
    return ranked.join(t, ["dataset_key", "model_key"], "left")
