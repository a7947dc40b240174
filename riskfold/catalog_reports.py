"""Registered queries of the report tables, the exploratory variants, and the
guards on data with planted violations (a check that always says "fine" would
fail them).  Imported by ``catalog`` at its end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskfold import catalog as C
from riskfold import sql_twins as Q
from riskfold.config import Settings
from riskfold.operators import checks as CK
from riskfold.operators import metrics as M
from riskfold.operators import profile as PR
from riskfold.operators import stability as ST
from riskfold.plans import experiments as EX
from riskfold.sources.tables import ACCOUNTS, LINES, raw_cohort

SET = Settings()
register = C.register


def _summary(spark, sf):
    s, t = C._scores(spark, sf)
    return M.dataset_ranks(M.cv_summary(M.fold_metrics(s, SET.threshold)), SET.primary_metric), t


# --------------------------------------------------------------------------- report tables
_OVERALL = ("mean_dataset_rank", "pr_auc_mean", "roc_auc_mean", "recall_mean", "f1_mean")


@register("overall_table", sql=C._MSQL("SELECT model_name, " + ", ".join(
    f"round_even(avg({'cv_rank' if c == 'mean_dataset_rank' else c}), 4) AS {c}" for c in _OVERALL) + " FROM mranked GROUP BY model_name"))
def q_overall_table(spark, sf):
    ranked, _ = _summary(spark, sf)
    return M.overall_comparison(ranked).select("model_name", *[F.bround(c, 4).alias(c) for c in _OVERALL])


@register("holdout_table", sql=C._MSQL("SELECT dataset_name, model_name, " + ", ".join(
    f"round_even({m}, 4) AS {m}" for m in M.METRICS) + " FROM test_metrics"))
def q_holdout_table(spark, sf):
    _, t = C._scores(spark, sf)
    out = M.binary_metrics(t, M.KEYS, SET.threshold)
    return out.select("dataset_name", "model_name", *[F.bround(m, 4).alias(m) for m in M.METRICS])


_SPREAD = [f"{m}_{x}" for m in M.METRICS for x in ("mean", "std", "range")]


@register("stability_table", sql=C._MSQL("SELECT dataset_name, model_name, " + ", ".join(
    f"round_even({c}, 4) AS {c}" for c in _SPREAD) + " FROM mranked"))
def q_stability_table(spark, sf):
    ranked, _ = _summary(spark, sf)
    return ranked.select("dataset_name", "model_name", *[F.bround(c, 4).alias(c) for c in _SPREAD])


@register("stability_extremes", rounded=("roc_auc_std",), sql=C._MSQL(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{side}' AS side, dataset_key, model_key, roc_auc_std FROM cv_summary "
    f"ORDER BY roc_auc_std {how}, dataset_key, model_key LIMIT 1)" for side, how in (("most", "ASC"), ("least", "DESC")))))
def q_stability_extremes(spark, sf):
    """Dataset and model whose ROC-AUC varies least and most over the folds."""
    ranked, _ = _summary(spark, sf)
    own = ranked.select("dataset_key", "model_key", "roc_auc_std")
    ends = [own.orderBy(order, "dataset_key", "model_key").limit(1).select(F.lit(side).alias("side"), "*")
            for side, order in (("most", F.asc("roc_auc_std")), ("least", F.desc("roc_auc_std")))]
    return ends[0].unionByName(ends[1])


# --------------------------------------------------------------------------- exploratory variants
@register("value_counts_all", rounded=("pct",), sql=C._RAWA("""
SELECT column, value, n, pct, row_number() OVER (PARTITION BY column ORDER BY n DESC, value NULLS LAST) AS place FROM (
  SELECT column, value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY column) AS pct FROM (
    SELECT 'c_mktsegment' AS column, c_mktsegment AS value FROM raw UNION ALL
    SELECT 'negative_balance', negative_balance FROM raw) GROUP BY column, value)"""))
def q_value_counts_all(spark, sf):
    return PR.value_counts(raw_cohort(spark, sf, "accounts"), ["c_mktsegment", "negative_balance"], nulls=True, ordered=True)


_SEGMENTS = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE", "NONE SUCH"]


@register("rate_by_category_ordered", rounded=("rate",), sql=C._RAWA("""
SELECT o.position, o.c_mktsegment, coalesce(n, 0) AS n, rate FROM (VALUES """
    + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_SEGMENTS)) + """) AS o(position, c_mktsegment) LEFT JOIN (
  SELECT c_mktsegment, count(*) AS n, 100.0 * avg(CASE WHEN negative_balance = 'Yes' THEN 1.0 ELSE 0.0 END) AS rate
  FROM raw GROUP BY c_mktsegment) r USING (c_mktsegment)"""))
def q_rate_by_category_ordered(spark, sf):
    return PR.rate_by_category(raw_cohort(spark, sf, "accounts"), "c_mktsegment", "negative_balance", order=_SEGMENTS)


@register("outlier_counts_train", rounded=("lower", "upper"), sql=Q.with_ctes(LINES, "SELECT column, lower, upper, split, "
          "count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers FROM lv JOIN q USING (column) GROUP BY column, lower, upper, split",
          "lv AS (SELECT split, 'l_extendedprice' AS column, CAST(l_extendedprice AS DOUBLE) AS value FROM split UNION ALL "
          "SELECT split, 'l_discount', CAST(l_discount AS DOUBLE) FROM split),\n"
          "q AS (SELECT column, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower, "
          "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper "
          "FROM lv WHERE value IS NOT NULL AND split = 'train' GROUP BY column)"))
def q_outlier_counts_train(spark, sf):
    """Fences from the training rows only, outliers counted on each side."""
    a = C.materialize(C.clean_and_split(spark, sf, LINES, SET))
    return PR.outlier_counts(a, ["l_extendedprice", "l_discount"], SET.iqr_multiplier, fit="split = 'train'", by="split")


# --------------------------------------------------------------------------- guards on planted violations
@register("metric_guards_planted", sql=C._MSQL(f"""
SELECT {Q.KEYS_SQL}, fold, count(*) AS n, CAST(coalesce(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pos,
       CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       count(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) AS n_bad_label,
       count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS n_bad_score,
       (sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) > 0
        AND count(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) = 0
        AND count(*) FILTER (WHERE score IS NULL OR isnan(score)) = 0) AS ok
FROM (SELECT {Q.KEYS_SQL}, fold, CASE WHEN fold = 1 AND row_id < '1' THEN 2 WHEN fold = 2 AND row_id < '08' THEN NULL
                                      WHEN fold = 4 THEN 1 ELSE y END AS y,
             CASE WHEN fold = 3 AND row_id < '1' THEN 'nan'::DOUBLE WHEN fold = 3 AND row_id < '2' THEN NULL ELSE score END AS score
      FROM scores) GROUP BY ALL"""))
def q_metric_guards_planted(spark, sf):
    """Labels outside {0, 1} and null labels, null and NaN scores, a fold of
    one class: each must be counted and refused."""
    s, _ = C._scores(spark, sf)
    y = F.when((F.col("fold") == 1) & (F.col("row_id") < "1"), 2).when((F.col("fold") == 2) & (F.col("row_id") < "08"), None) \
         .when(F.col("fold") == 4, 1).otherwise(F.col("y"))
    score = F.when((F.col("fold") == 3) & (F.col("row_id") < "1"), float("nan")).when((F.col("fold") == 3) & (F.col("row_id") < "2"), None) \
             .otherwise(F.col("score"))
    return M.metric_guards(s.withColumn("y", y).withColumn("score", score), C._FK)


@register("validate_folds_planted", sql=Q.with_ctes(LINES, f"""
SELECT 'missing_fold' AS "check", count(*) AS n_violations, count(*) = 0 AS ok FROM dev d LEFT JOIN man m USING (row_id) WHERE m.fold IS NULL
UNION ALL SELECT 'unknown_row', count(*), count(*) = 0 FROM man m LEFT JOIN dev d USING (row_id) WHERE d.row_id IS NULL
UNION ALL SELECT 'duplicate_row', count(*), count(*) = 0 FROM (SELECT row_id FROM man GROUP BY row_id HAVING count(*) > 1)
UNION ALL SELECT 'fold_count_off', abs(count(DISTINCT fold) - {SET.n_folds}), count(DISTINCT fold) = {SET.n_folds} FROM man
UNION ALL SELECT 'empty_side', CASE WHEN count(DISTINCT fold) < 2 THEN 1 ELSE 0 END, count(DISTINCT fold) >= 2 FROM man""", """
man AS (SELECT row_id, fold FROM dev WHERE row_id >= '1' UNION ALL SELECT row_id, fold FROM dev WHERE row_id >= 'f'
        UNION ALL SELECT 'stranger', 7)"""))
def q_validate_folds_planted(spark, sf):
    """A manifest that lacks rows, repeats rows, knows a stranger and a sixth fold."""
    dev = C._lines_folds(spark, sf)
    own = dev.select("row_id", "fold")
    stranger = spark.createDataFrame([("stranger", 7)], "row_id string, fold int")
    bad = own.where("row_id >= '1'").unionByName(own.where("row_id >= 'f'")).unionByName(stranger)
    return CK.validate_folds(dev.select("row_id"), bad, SET.n_folds)


# --------------------------------------------------------------------------- rankings as given
@register("pairwise_spearman_given", rounded=("spearman_rho",), sql=C._PW("""
SELECT a.dataset_key, a.model_key, a.fold AS fold_a, b.fold AS fold_b, CASE WHEN count(*) >= 2 THEN corr(a.rank, b.rank) END AS spearman_rho
FROM xr a JOIN xr b ON a.dataset_key = b.dataset_key AND a.model_key = b.model_key AND a.feature = b.feature AND a.fold < b.fold
GROUP BY a.dataset_key, a.model_key, a.fold, b.fold"""))
def q_pairwise_spearman_given(spark, sf):
    pairs = ST.fold_pairs(C._first_imp(spark, sf), SET.top_k)
    return ST.spearman_of_given_ranks(pairs).select("dataset_key", "model_key", "fold_a", "fold_b", "spearman_rho")


# --------------------------------------------------------------------------- the models end to end
@register("model_holdout_metrics")
def q_model_holdout_metrics(spark, sf):
    """Hold-out row of each boosted model: sizes, positive rates, metrics, fit seconds."""
    sc = C._held_scores(spark, sf)
    sizes = sc.groupBy(*M.KEYS).agg(F.count_if(F.col("g") >= 0).alias("n_development"), F.count_if(F.col("g") == -1).alias("n_test"),
                                    F.avg(F.when(F.col("g") >= 0, F.col("y"))).alias("development_positive_rate"),
                                    F.avg(F.when(F.col("g") == -1, F.col("y"))).alias("test_positive_rate"))
    return EX.with_fit_seconds(sizes.join(M.binary_metrics(sc.where("g = -1"), M.KEYS, SET.threshold), M.KEYS), C._all_models(spark, sf))


_SIDES = """SELECT '{key}' AS dataset_key, count(*) FILTER (WHERE split = 'train') AS n_development, count(*) FILTER (WHERE split = 'test') AS n_test,
       avg(CASE WHEN split = 'train' THEN CAST({t} AS DOUBLE) END) AS development_positive_rate,
       avg(CASE WHEN split = 'test' THEN CAST({t} AS DOUBLE) END) AS test_positive_rate FROM split"""


@register("model_holdout_sizes", rounded=("development_positive_rate", "test_positive_rate"),
          sql=Q.with_ctes(ACCOUNTS, "SELECT m.model_key, s.* FROM (" + _SIDES.format(key=ACCOUNTS.key, t=ACCOUNTS.target)
                          + ") s, (VALUES ('adaboost'), ('xgboost'), ('lightgbm')) m(model_key)"))
def q_model_holdout_sizes(spark, sf):
    """Sizes and positive rates of the boosted models' hold-out rows."""
    rows = q_model_holdout_metrics(spark, sf)
    return rows.select("model_key", "dataset_key", "n_development", "n_test", "development_positive_rate", "test_positive_rate")


@register("model_score_guards", sql=Q.with_ctes(ACCOUNTS, """
SELECT m.model_key, fold, n, n_pos, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_repeated
FROM (SELECT fold, count(*) AS n, count(*) FILTER (WHERE negative_balance = 1) AS n_pos FROM dev GROUP BY fold
      UNION ALL SELECT -1, count(*), count(*) FILTER (WHERE negative_balance = 1) FROM test) s,
     (VALUES ('adaboost'), ('xgboost'), ('lightgbm')) m(model_key)"""))
def q_model_score_guards(spark, sf):
    """Every validation and hold-out row is scored once by each model, with a
    probability between 0 and 1."""
    each = C._scores_of(spark, sf).groupBy("model_key", F.col("g").alias("fold"), "row_id").agg(
        F.count(F.lit(1)).alias("c"), F.max("y").alias("y"), F.max((~F.coalesce(F.col("score").between(0, 1), F.lit(False))).cast("int")).alias("bad"))
    return each.groupBy("model_key", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"),
                                                 F.sum("bad").alias("n_outside"), F.count_if(F.col("c") > 1).alias("n_repeated"))


@register("validate_columns", sql=Q.with_ctes(ACCOUNTS, """
SELECT * FROM (VALUES ('no_target', 0::BIGINT, true), ('unshared_column', 0::BIGINT, true), ('other_order', 0::BIGINT, true), ('not_numeric', 0::BIGINT, true))
  v("check", n_violations, ok) WHERE EXISTS (SELECT 1 FROM dev)"""))
def q_validate_columns(spark, sf):
    """Schemas of the processed splits as they are written."""
    from riskfold.plans.process import process
    wide = process(spark, sf, ACCOUNTS, SET).wide()
    return CK.validate_columns(wide.where("split = 'train'"), wide.where("split = 'test'"), ACCOUNTS.target)


@register("validate_columns_planted", sql=Q.with_ctes(ACCOUNTS, """
SELECT * FROM (VALUES ('no_target', 1::BIGINT, false), ('unshared_column', 2::BIGINT, false), ('other_order', 2::BIGINT, false), ('not_numeric', 1::BIGINT, false))
  v("check", n_violations, ok) WHERE EXISTS (SELECT 1 FROM dev)"""))
def q_validate_columns_planted(spark, sf):
    """A test split without the target, with a text column and two columns in
    exchanged places."""
    from riskfold.plans.process import process
    wide = process(spark, sf, ACCOUNTS, SET).wide()
    test = wide.where("split = 'test'")
    a, b = "n_orders", "avg_order_value"
    swapped = [b if c == a else a if c == b else c for c in test.columns if c != ACCOUNTS.target]
    return CK.validate_columns(wide.where("split = 'train'"), test.select(*swapped, F.lit("text").alias("note")), ACCOUNTS.target)


@register("importance_sink", rounded=("mean_abs_shap",), sql=C._IMP("SELECT * FROM imp"))
def q_importance_sink(spark, sf):
    """The importance frame written as a result table and read back."""
    import uuid

    from riskfold.sources.files import write_table
    folder = f"{C.ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-importance-{uuid.uuid4().hex}"
    write_table(C.importance_frame(spark, sf), folder)
    return spark.read.parquet(folder)


@register("holdout_sink", rounded=("development_positive_rate", "test_positive_rate"),
          sql=Q.with_ctes(ACCOUNTS, "SELECT m.model_key, s.* FROM (" + _SIDES.format(key=ACCOUNTS.key, t=ACCOUNTS.target)
                          + ") s, (VALUES ('adaboost'), ('xgboost'), ('lightgbm')) m(model_key)"))
def q_holdout_sink(spark, sf):
    """The hold-out rows of the models written as a result table and read back."""
    import uuid

    from riskfold.sources.files import write_table
    folder = f"{C.ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-holdout-{uuid.uuid4().hex}"
    write_table(q_model_holdout_metrics(spark, sf), folder)
    back = spark.read.parquet(folder)
    return back.select("model_key", "dataset_key", "n_development", "n_test", "development_positive_rate", "test_positive_rate")


@register("model_experiment")
def q_model_experiment(spark, sf):
    """CV summary, rank and hold-out metrics of the boosted models."""
    sc = C._held_scores(spark, sf)
    ranked = M.dataset_ranks(M.cv_summary(M.fold_metrics(sc.where("g >= 0"), SET.threshold)), SET.primary_metric)
    return M.model_comparison(ranked, M.binary_metrics(sc.where("g = -1"), M.KEYS, SET.threshold))


@register("result_sinks", rounded=("pr_auc",), sql=C._MSQL(f"SELECT {Q.KEYS_SQL}, fold + 1 AS fold, pr_auc FROM fold_metrics"))
def q_result_sinks(spark, sf):
    """Fold metrics and ranks written as result tables and read back; folds
    are numbered from 1 in result tables."""
    import uuid

    from riskfold.sources.files import write_table
    folder = f"{C.ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-results-{uuid.uuid4().hex}"
    s, _ = C._scores(spark, sf)
    folds = M.fold_metrics(s, SET.threshold)
    write_table(folds.withColumn("fold", F.col("fold") + 1), f"{folder}/fold_metrics")
    back = spark.read.parquet(f"{folder}/fold_metrics")
    write_table(M.dataset_ranks(M.cv_summary(back)), f"{folder}/cv_summary")
    kept = spark.read.parquet(f"{folder}/cv_summary").select(*M.KEYS, F.row_number().over(Window.partitionBy(*M.KEYS).orderBy("cv_rank")).alias("_one"))
    return back.join(kept.where("_one = 1").drop("_one"), M.KEYS).select(*M.KEYS, "fold", "pr_auc")
