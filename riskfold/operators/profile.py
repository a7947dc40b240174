"""Exploratory aggregates: profiles, missing values, describe, value counts,
correlations, event rates, box statistics, placeholder zeros, outliers,
duplicates.  Each is one or two aggregate jobs over the unpivoted columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.quantiles import column_quantiles, quantile_columns
from riskfold.session import materialize


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, pct_missing) for columns with missing values."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    lv = agg.unpivot(["_n"], columns, "column", "n_missing")
    return lv.where("n_missing > 0").select("column", "n_missing",
                                            F.bround(100.0 * F.col("n_missing") / F.col("_n"), 2).alias("pct_missing"))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column."""
    narrow = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))   # read by the moments and the quantiles
    lv = narrow.unpivot([], columns, "column", "value")
    base = lv.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    q = column_quantiles(narrow, [], columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(q, "column").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, columns: list[str], nulls: bool = False, ordered: bool = False) -> DataFrame:
    """(column, value, n, pct[, place]): pct of the counted rows of the column;
    ``nulls`` counts the missing value, too; ``ordered`` adds the place by
    count, then value (missing last)."""
    lv = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    c = (lv if nulls else lv.where(F.col("value").isNotNull())).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("column")))
    if not ordered:
        return c
    place = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return c.withColumn("place", F.row_number().over(place))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signed Pearson correlation of every column pair (long, a before b)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return agg.selectExpr(f"stack({len(pairs)}, {stack}) as (column_a, column_b, r)")


def rate_by_category(df: DataFrame, category: str, target: str, positive="Yes", order: list[str] | None = None) -> DataFrame:
    """Event rate (%) per category; NULL categories dropped; NULL labels stay in
    the denominator (the share of rows equal to the positive label).  ``order``
    fixes the categories and their ``position``; one without rows has n = 0
    and no rate."""
    rates = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.avg(F.when(F.col(target) == F.lit(positive), 1.0).otherwise(0.0))).alias("rate"))
    if order is None:
        return rates
    places = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, `{category}` string")
    return places.join(rates, category, "left").select("position", category, F.coalesce("n", F.lit(0)).alias("n"), "rate")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles and whiskers (furthest values inside 1.5 IQR) per group."""
    x = materialize(df.select(F.col(by), F.col(value).cast("double").alias("v")).where(F.col(by).isNotNull()))
    q = quantile_columns(x, [by], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    j = x.join(q, by)   # a row a group: broadcast by the planner while it is small
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= F.col("q1") - 1.5 * iqr, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("q3") + 1.5 * iqr, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < F.col("q1") - 1.5 * iqr) | (F.col("v") > F.col("q3") + 1.5 * iqr)).alias("n_outliers"))


def zero_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    lv = agg.unpivot(["_n"], columns, "column", "n_zero")
    return lv.select("column", "n_zero", (100.0 * F.col("n_zero") / F.col("_n")).alias("pct_zero"))


def outlier_counts(df: DataFrame, columns: list[str], multiplier: float = 1.5, fit: str | None = None,
                   by: str | None = None) -> DataFrame:
    """Tukey fences of each column over all rows (or those where ``fit``
    holds), and how many rows fall outside (per value of ``by``)."""
    ids = [by] if by else []
    rows = materialize(df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns], *([F.expr(fit).alias("_fit")] if fit else [])))
    q = column_quantiles(rows.where("_fit") if fit else rows, [], columns, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    q = q.select("column", (F.col("q1") - multiplier * iqr).alias("lower"), (F.col("q3") + multiplier * iqr).alias("upper"))
    lv = rows.unpivot(ids, columns, "column", "value")
    j = lv.join(F.broadcast(q), "column")   # a row a column
    return j.groupBy("column", "lower", "upper", *ids).agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row: n - distinct rows."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    agg = g.agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("n_duplicates"))
    return agg.select(F.col("n_rows").cast("long"), F.col("n_duplicates").cast("long"),
                      (100.0 * F.col("n_duplicates") / F.col("n_rows")).alias("pct_duplicates"))
