"""Driver tables (parquet) and the three stand-in cohorts built from them.

Each cohort plays the role of one of the study's source tables (schemas in
FIXTURES.md): a large mostly-numeric cohort with a 0/1 target, a survey-like
cohort with a Yes/No text target and missing values, and a small labelled
cohort with duplicates removed.  Builders only select the columns they need so
the parquet scan prunes columns; joins are left to the planner (AQE picks
broadcast for the small dimension sides at run time, sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.config import Cohort

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


LINES = Cohort(
    key="lines",
    name="Order lines: returned-item risk",
    target="returned",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"),
    categorical=("l_linestatus", "o_orderstatus", "o_orderpriority", "p_brand"),
    zero_as_missing=("l_discount",),
    iqr_columns=("l_extendedprice", "p_retailprice"),
    key_columns=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
)

ACCOUNTS = Cohort(
    key="accounts",
    # planted: the balance falls short of what the orders tie up, so that a model can learn it from n_orders
    name="Customer accounts: negative balance",
    target="negative_balance",
    numeric=("n_orders", "avg_order_value", "total_order_value"),
    categorical=("c_mktsegment", "n_name", "r_name"),
    key_columns=("c_custkey",),
)

DOCS = Cohort(
    key="docs",
    name="Labelled documents: quality",
    target="quality",
    numeric=("n_chars",),
    categorical=("lang", "source", "toxic"),
    dedupe=True,
)

COHORTS = {c.key: c for c in (LINES, ACCOUNTS, DOCS)}


def _md5_prefix_is(salt: str, key: str, prefix: str):
    """Deterministic pseudo-random mask (same md5 text in DuckDB)."""
    return F.substring(F.md5(F.concat(F.lit(salt + "|"), F.col(key).cast("string"))), 1, len(prefix)) == prefix


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                           "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                           "l_returnflag", "l_linestatus"])
    od = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    pt = table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    j = li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
    return j.select(
        *LINES.key_columns,
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "p_size", "p_retailprice",
        "l_linestatus", "o_orderstatus", "o_orderpriority", "p_brand",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
    )


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    od = table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice"])
    na = table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    rg = table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    per_cust = od.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("avg_order_value"),
        F.sum("o_totalprice").alias("total_order_value"),
    )
    j = (cu.join(per_cust, cu.c_custkey == per_cust.o_custkey, "left")
           .join(na, cu.c_nationkey == na.n_nationkey, "left")
           .join(rg, na.n_regionkey == rg.r_regionkey, "left"))
    return j.select(
        "c_custkey",
        "n_orders",
        F.when(_md5_prefix_is("aov", "c_custkey", "1"), None).otherwise(F.col("avg_order_value"))
         .alias("avg_order_value"),
        "total_order_value",
        F.when(_md5_prefix_is("seg", "c_custkey", "0"), None).otherwise(F.col("c_mktsegment"))
         .alias("c_mktsegment"),
        "n_name", "r_name",
        F.when(_md5_prefix_is("target", "c_custkey", "00"), None)
         .when(F.col("c_acctbal") + 1500 < 400 * F.coalesce("n_orders", F.lit(0.0)), "Yes").otherwise("No").alias("negative_balance"),
    )


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dc = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    lb = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    j = dc.join(lb, "doc_id")
    return j.select("n_chars", "lang", "source",
                    F.col("toxic").cast("string").alias("toxic"), "quality")


RAW_BUILDERS = {"lines": raw_lines, "accounts": raw_accounts, "docs": raw_docs}


def raw_cohort(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return RAW_BUILDERS[key](spark, sf_dir)
