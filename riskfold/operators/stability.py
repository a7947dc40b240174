"""Feature-ranking stability across folds.

Input: an importance frame ``(dataset_key, dataset_name, model_key,
model_name, fold, feature, mean_abs_shap, rank)``.  Fold pairs come from a
self-join on (dataset, model, feature) with ``fold_a < fold_b``; its size is
features x folds^2, both bounded by the model's schema and the fold count,
never by the data rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.session import ship_package

GK = ["dataset_key", "dataset_name", "model_key", "model_name"]
REQUIRED = set(GK + ["fold", "feature", "mean_abs_shap", "rank"])


def importance_ranks(imp: DataFrame, value: str = "mean_abs_shap") -> DataFrame:
    """Unique rank 1..p per fold: importance desc, ties by feature order."""
    w = Window.partitionBy(*GK, "fold").orderBy(F.desc(value), "feature")
    return imp.withColumn("rank", F.row_number().over(w))


def _check(imp: DataFrame, top_k: int | None = None) -> None:
    missing = REQUIRED - set(imp.columns)
    if missing:
        raise ValueError(f"the importance table lacks {', '.join(sorted(missing))}")
    if top_k is not None and top_k < 1:
        raise ValueError(f"top_k = {top_k}: a positive count is needed")


def _first_per_feature(imp: DataFrame) -> DataFrame:
    """A feature repeated inside a fold keeps its first row (by rank)."""
    w = Window.partitionBy(*GK, "fold", "feature").orderBy("rank")
    return imp.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def fold_pairs(imp: DataFrame, top_k: int) -> DataFrame:
    """(GK..., fold_a, fold_b, feature, ra, rb, ta, tb): ranks of a feature in
    both folds of every pair, among the features that the two folds share, and
    top-k membership (k clipped to p, rank ties broken by feature name)."""
    x = _first_per_feature(imp)
    p = Window.partitionBy(*GK, "fold")
    o = Window.partitionBy(*GK, "fold").orderBy("rank", "feature")
    x = x.withColumn("_p", F.count(F.lit(1)).over(p)) \
         .withColumn("top", F.row_number().over(o) <= F.least(F.lit(top_k), F.col("_p")))
    a = x.select(*GK, F.col("fold").alias("fold_a"), "feature", F.col("rank").alias("rka"), F.col("top").alias("ta"), F.col("_p").alias("pa"))
    b = x.select(*GK, F.col("fold").alias("fold_b"), "feature", F.col("rank").alias("rkb"), F.col("top").alias("tb"), F.col("_p").alias("pb"))
    shared = a.join(b, [*GK, "feature"]).where(F.col("fold_a") < F.col("fold_b"))
    for side in "ab":
        w = Window.partitionBy(*GK, "fold_a", "fold_b").orderBy(f"rk{side}")
        t = Window.partitionBy(*GK, "fold_a", "fold_b", f"rk{side}")
        shared = shared.withColumn(f"r{side}", F.rank().over(w) + (F.count(F.lit(1)).over(t) - 1) / 2.0)
    return shared


def all_fold_pairs(imp: DataFrame) -> DataFrame:
    """(GK, fold_a, fold_b, size_a, size_b): every pair of folds with its
    feature counts, also where the folds share no feature."""
    sizes = imp.groupBy(*GK, "fold").agg(F.countDistinct("feature").alias("size"))
    a = sizes.select(*GK, F.col("fold").alias("fold_a"), F.col("size").alias("size_a"))
    b = sizes.select(*GK, F.col("fold").alias("fold_b"), F.col("size").alias("size_b"))
    return a.join(b, GK).where(F.col("fold_a") < F.col("fold_b"))


def pairwise_spearman(pairs: DataFrame) -> DataFrame:
    """(GK, fold_a, fold_b, n_features, spearman_rho): Pearson of average
    ranks; fewer than 2 features -> 1.0; undefined -> 1.0 when identical else 0.0."""
    agg = pairs.groupBy(*GK, "fold_a", "fold_b").agg(
        F.count(F.lit(1)).alias("n_features"), F.corr("ra", "rb").alias("_r"),
        F.min(F.col("ra") == F.col("rb")).alias("_same"), F.max("pa").alias("_pa"), F.max("pb").alias("_pb"))
    rho = F.when(F.col("n_features") < 2, 1.0).when(F.col("_r").isNull() | F.isnan("_r"),
                                                    F.when(F.col("_same"), 1.0).otherwise(0.0)).otherwise(F.col("_r"))
    return agg.select(*GK, "fold_a", "fold_b", "n_features", rho.alias("spearman_rho"), "_pa", "_pb")


def spearman_of_given_ranks(pairs: DataFrame) -> DataFrame:
    """(GK, fold_a, fold_b, spearman_rho): Pearson of the ranks as they are
    given, without ranking anew; no value below two features."""
    agg = pairs.groupBy(*GK, "fold_a", "fold_b").agg(F.count(F.lit(1)).alias("_n"), F.corr("rka", "rkb").alias("_r"))
    return agg.select(*GK, "fold_a", "fold_b", F.when(F.col("_n") >= 2, F.col("_r")).alias("spearman_rho"))


def _inversions(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j], by merging sorted halves."""
    count, n = 0, len(v)
    if n < 2:
        return 0
    runs = [v[i:i + 1] for i in range(n)]
    while len(runs) > 1:
        merged = []
        for left, right in zip(runs[::2], runs[1::2]):
            count += int((len(left) - np.searchsorted(left, right, "right")).sum())
            merged.append(np.sort(np.concatenate([left, right]), kind="stable"))
        runs = merged + ([runs[-1]] if len(runs) % 2 else [])
    return count


def _tied(*columns: np.ndarray) -> int:
    """Pairs that agree in all columns."""
    _, n = np.unique(np.stack(columns), axis=1, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def kendall_tau(a: np.ndarray, b: np.ndarray) -> float:
    """tau-b in O(n log n): concordant less discordant pairs from the number
    of pairs, the ties and the inversions of b in the order of (a, b)."""
    n = len(a)
    pairs = n * (n - 1) // 2
    untied_a, untied_b = pairs - _tied(a), pairs - _tied(b)
    if untied_a == 0 or untied_b == 0:
        return 1.0 if untied_a == untied_b else 0.0
    surplus = pairs - (pairs - untied_a) - (pairs - untied_b) + _tied(a, b) - 2 * _inversions(b[np.lexsort((b, a))])
    return surplus / float(np.sqrt(float(untied_a) * float(untied_b)))


def pairwise_kendall(pairs: DataFrame) -> DataFrame:
    """(GK, fold_a, fold_b, kendall_tau): tau-b of the features' ranks; fold
    pairs with fewer than two shared features have no row.  A fold pair's two
    rankings (one number a feature) are one task's arrays."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("double")
    def tau(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kendall_tau(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)], dtype=float)

    both = pairs.groupBy(*GK, "fold_a", "fold_b").agg(F.collect_list(F.struct("ra", "rb")).alias("_r")).where(F.size("_r") >= 2)
    return both.select(*GK, "fold_a", "fold_b", tau(F.col("_r.ra"), F.col("_r.rb")).alias("kendall_tau"))


def topk_jaccard(pairs: DataFrame, top_k: int) -> DataFrame:
    """(GK, fold_a, fold_b, top_k, top_k_jaccard)."""
    agg = pairs.groupBy(*GK, "fold_a", "fold_b").agg(
        F.sum(F.when(F.col("ta") & F.col("tb"), 1).otherwise(0)).alias("_i"),
        F.sum(F.when(F.col("ta") | F.col("tb"), 1).otherwise(0)).alias("_u"),
        F.count(F.lit(1)).alias("_n"))
    return agg.select(*GK, "fold_a", "fold_b", F.least(F.lit(top_k), F.col("_n")).cast("int").alias("top_k"),
                      F.when(F.col("_u") == 0, 1.0).otherwise(F.col("_i") / F.col("_u")).alias("top_k_jaccard"))


def pairwise_stability(imp: DataFrame, top_k: int) -> DataFrame:
    """One row per fold pair: n_features, top_k, kendall_tau, spearman_rho,
    top_k_jaccard.  Feature sets that differ between folds fail the job."""
    _check(imp, top_k)
    pairs = fold_pairs(imp, top_k)
    keys = [*GK, "fold_a", "fold_b"]
    sp = pairwise_spearman(pairs)
    out = all_fold_pairs(imp).join(sp, keys, "left").join(pairwise_kendall(pairs), keys, "left")
    out = out.join(topk_jaccard(pairs, top_k), keys, "left")
    matched = F.coalesce("n_features", F.lit(0))
    unlike = F.concat(F.lit("folds "), F.col("fold_a").cast("string"), F.lit(" and "), F.col("fold_b").cast("string"),
                      F.lit(" rank different features"))
    out = out.withColumn("n_features", F.when((matched != F.col("size_a")) | (matched != F.col("size_b")),
                                              F.raise_error(unlike).cast("long")).otherwise(F.col("n_features")))
    tau = F.when(F.col("n_features") < 2, 1.0).otherwise(F.coalesce("kendall_tau", F.lit(1.0)))
    return out.select(*keys, "n_features", "top_k", tau.alias("kendall_tau"), "spearman_rho", "top_k_jaccard")


def stability_summary(pw: DataFrame) -> DataFrame:
    """Per (dataset, model, top_k): pair_count, n_folds from the pair count,
    n_features, mean/std/min/max of the three statistics (std 0 for one pair)."""
    aggs = [F.count(F.lit(1)).alias("pair_count"), F.first("n_features").alias("n_features")]
    for col, name in (("kendall_tau", "kendall_tau"), ("spearman_rho", "spearman"), ("top_k_jaccard", "top_k_jaccard")):
        aggs += [F.avg(col).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias(f"{name}_std"),
                 F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max")]
    s = pw.groupBy(*GK, "top_k").agg(*aggs)
    return s.withColumn("n_folds", F.round((1 + F.sqrt(1 + 8 * F.col("pair_count").cast("double"))) / 2).cast("int"))


def consensus_ranking(imp: DataFrame, top_k: int) -> DataFrame:
    """Per (dataset, model, feature): mean importance, mean rank, rank std,
    top-k frequency, folds observed, unique consensus rank (ties: name)."""
    c = imp.groupBy(*GK, "feature").agg(
        F.avg("mean_abs_shap").alias("mean_abs_shap"), F.avg("rank").alias("mean_rank"),
        F.stddev_samp("rank").alias("rank_std"),
        F.avg(F.when(F.col("rank") <= top_k, 1.0).otherwise(0.0)).alias("top_k_frequency"),
        F.countDistinct("fold").alias("folds_observed"))
    w = Window.partitionBy("dataset_key", "model_key").orderBy("mean_rank", "feature")
    return c.withColumn("consensus_rank", F.row_number().over(w))


def rank_matrix(imp: DataFrame, max_features: int | None = None) -> DataFrame:
    """Long fold x feature rank matrix with the display order of features
    (mean rank asc, mean importance desc, name); optional top n.  A table
    without rows has no order to show and raises."""
    _check(imp)
    if imp.isEmpty():
        raise ValueError("no importance rows are selected")
    s = imp.groupBy(*GK, "feature").agg(F.avg("rank").alias("_mr"), F.avg("mean_abs_shap").alias("_mi"))
    w = Window.partitionBy("dataset_key", "model_key").orderBy("_mr", F.desc("_mi"), "feature")
    s = s.withColumn("feature_order", F.row_number().over(w))
    if max_features is not None:
        s = s.where(F.col("feature_order") <= max_features)
    m = imp.groupBy(*GK, "fold", "feature").agg(F.avg("rank").alias("rank"))
    return m.join(s.select(*GK, "feature", "feature_order"), [*GK, "feature"])


def shared_correlations(imp: DataFrame, method: str = "spearman") -> DataFrame:
    """(GK, fold_a, fold_b, value) for every pair of folds over the features
    they share; 1.0 where they share fewer than two.  ``method``: spearman or
    kendall."""
    if method not in ("spearman", "kendall"):
        raise ValueError(f"method {method!r}: spearman or kendall")
    _check(imp)
    keys, pairs = [*GK, "fold_a", "fold_b"], fold_pairs(imp, 1)
    stat = pairwise_spearman(pairs).select(*keys, F.col("spearman_rho").alias("value")) if method == "spearman" \
        else pairwise_kendall(pairs).select(*keys, F.col("kendall_tau").alias("value"))
    return all_fold_pairs(imp).join(stat, keys, "left").select(*keys, F.coalesce("value", F.lit(1.0)).alias("value"))


def fold_correlation_matrix(pw: DataFrame, folds: DataFrame, stat: str = "spearman_rho") -> DataFrame:
    """Symmetric fold x fold matrix (long) with a unit diagonal, from a pair
    table (``pairwise_stability``, or ``shared_correlations`` with "value")."""
    a = pw.select(*GK, "fold_a", "fold_b", F.col(stat).alias("value"))
    b = pw.select(*GK, F.col("fold_b").alias("fold_a"), F.col("fold_a").alias("fold_b"), F.col(stat).alias("value"))
    d = folds.select(*GK, F.col("fold").alias("fold_a"), F.col("fold").alias("fold_b"), F.lit(1.0).alias("value"))
    return a.unionByName(b).unionByName(d)


def ranking_lists(imp: DataFrame) -> DataFrame:
    """(GK, fold, ranking array<string>) ordered best first (bounded by p)."""
    s = imp.groupBy(*GK, "fold").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("_s"))
    return s.select(*GK, "fold", F.transform("_s", lambda e: e["feature"]).alias("ranking"))


def ranking_overlap(lists: DataFrame, k: int = 3) -> DataFrame:
    """Per pair of rankings: Spearman on positions and |top-k(a) & top-k(b)| / k.
    Different feature universes or k outside [1, p] fail the job."""
    a = lists.select(*GK, F.col("fold").alias("fold_a"), F.col("ranking").alias("la"))
    b = lists.select(*GK, F.col("fold").alias("fold_b"), F.col("ranking").alias("lb"))
    j = a.join(b, GK).where(F.col("fold_a") < F.col("fold_b"))
    same = F.size(F.array_except("la", "lb")) == 0
    n = F.size("la")
    pa = F.posexplode("la")
    pos = j.select(*GK, "fold_a", "fold_b", "lb", n.alias("n"), same.alias("same"), pa.alias("ia", "f"))
    pos = pos.withColumn("ib", F.array_position("lb", F.col("f")) - 1)
    d = pos.groupBy(*GK, "fold_a", "fold_b", "n", "same").agg(F.sum((F.col("ia") - F.col("ib")) ** 2).alias("d2"))
    rho = 1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1))
    ov = j.select(*GK, "fold_a", "fold_b",
                  (F.size(F.array_intersect(F.slice("la", 1, k), F.slice("lb", 1, k))) / F.lit(float(k))).alias("overlap"),
                  n.alias("_n"))
    out = d.join(ov, [*GK, "fold_a", "fold_b"])
    bad = ~F.col("same") | (F.lit(k) < 1) | (F.lit(k) > F.col("_n"))
    return out.select(*GK, "fold_a", "fold_b",
                      F.when(bad, F.raise_error(F.lit("rankings must cover the same features and 1 <= k <= p")))
                      .otherwise(rho).cast("double").alias("spearman"), "overlap")


def ranking_stability(ov: DataFrame, lists: DataFrame) -> DataFrame:
    """Mean pairwise Spearman and top-k overlap, and the number of rankings."""
    n = lists.groupBy(*GK).agg(F.count(F.lit(1)).cast("double").alias("n_rankings"))
    m = ov.groupBy(*GK).agg(F.avg("spearman").alias("spearman"), F.avg("overlap").alias("top_k_overlap"))
    return m.join(n, GK)
