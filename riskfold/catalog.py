"""Registered queries: one per operator of the inventory, each a Spark job
over the driver tables plus (where SQL can state it) a DuckDB twin.

Doubles are rounded to 6 decimals on both sides (the study writes its
matrices with six decimals; summation order differs between engines).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold import sql_twins as Q
from riskfold.config import Settings
from riskfold.operators import clean as C
from riskfold.operators import prep as P
from riskfold.operators import split as S
from riskfold.session import ensure_checkpoint_dir, materialize, settle
from riskfold.plans.assign import assign, clean_and_split, clean_rows, dev_and_test
from riskfold.sources.files import normalise_missing
from riskfold.sources.tables import ACCOUNTS, DOCS, LINES, raw_cohort, table

SET = Settings()
# Both sides add this before rounding to 6 decimals, so a value that is an
# exact 7-digit decimal (common for means of 2-decimal data) does not flip
# between engines on a last-bit difference.
ROUND_BIAS = 1e-9


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if rounded:
                df = df.select(*[F.round(F.col(c) + F.lit(ROUND_BIAS), 6).alias(c) if c in rounded else F.col(c)
                                 for c in df.columns])
            return df
        wrapped_sql = None
        if sql is not None:
            # ``column`` is a keyword in DuckDB: quote it wherever it is an identifier
            wrapped_sql = re.sub(r'(?<!["\w.])column(?!["\w])', '"column"', sql)
            if rounded:
                rep = ", ".join(f"round({c} + {ROUND_BIAS!r}, 6) AS {c}" for c in rounded)
                wrapped_sql = f"SELECT * REPLACE ({rep}) FROM ({wrapped_sql}) AS _q"
        REGISTRY[name] = Entry(run, wrapped_sql, rounded)
        return fn
    return deco


def _lines_split(spark, sf):
    """Row id, target, split and fold of all rows."""
    return dev_and_test(assign(spark, sf, LINES, SET, columns=[]))


def _lines_folds(spark, sf):
    """Row id, target and fold of the development rows, ranked once."""
    return _lines_split(spark, sf)[0]


def _train(spark, sf, cohort, columns=None):
    """Development/test rows and the fold-expanded training view, for queries
    that need only part of the fitted state (and of the columns)."""
    a = assign(spark, sf, cohort, SET, columns)
    dev, test = dev_and_test(a)
    return dev, test, S.train_view(dev, SET.n_folds)


def _fitted(spark, sf, cohort):
    # every fitted statistic re-reads the assigned rows, which are held in a folder
    a = assign(spark, sf, cohort, SET)
    dev, test = dev_and_test(a)
    tr = S.train_view(dev, SET.n_folds)
    return dev, test, tr, P.fit(tr, cohort.numeric, cohort.categorical, cohort.iqr_columns, SET.iqr_multiplier, dev, S.fold_fits(SET.n_folds))


# =========================================================================== 2.1 / 2.2 scans and cleaning
@register("scan_normalise", sql=f"""
SELECT o_orderkey, {Q.na_case('o_orderstatus', True)} AS o_orderstatus,
       {Q.na_case('o_orderpriority', True)} AS o_orderpriority, {Q.na_case('o_totalprice', False)} AS o_totalprice
FROM orders""")
def q_scan_normalise(spark, sf):
    return normalise_missing(table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority",
                                                          "o_totalprice"]))


_CSV_COLS = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "date"}


def _planted(column: str) -> str:
    """Where a row's order key hash puts NA tokens (both engines)."""
    return f"substr(md5('{column}' || cast(o_orderkey as varchar(20))), 1, 1) = '7'"


@register("csv_scan", rounded=("o_totalprice",), sql="SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN {_planted(c)} THEN NULL ELSE {c if t != 'date' else 'CAST(CAST(' + c + ' AS DATE) AS VARCHAR)'} END AS {c}" for c, t in _CSV_COLS.items() if c != "o_orderkey") + " FROM orders")
def q_csv_scan(spark, sf):
    """Round trip: orders written as CSV with NA tokens of several kinds in
    text and typed columns and blanks around the header names, read back."""
    from riskfold.sources.files import NA_TOKENS, read_csv
    token = F.element_at(F.array(*[F.lit(t) for t in NA_TOKENS if t]), (F.pmod("o_orderkey", F.lit(len(NA_TOKENS) - 1)) + 1).cast("int"))
    rows = table(spark, sf, "orders", list(_CSV_COLS))
    out = rows.select("o_orderkey", *[F.when(F.expr(_planted(c)), token).otherwise(F.col(c).cast(t).cast("string")).alias(f" {c} ")
                                      for c, t in _CSV_COLS.items() if c != "o_orderkey"])
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    schema = T.StructType([T.StructField(c if c == "o_orderkey" else f" {c} ", T._parse_datatype_string(t)) for c, t in _CSV_COLS.items()])
    back = read_csv(spark, folder, schema, target="o_orderstatus")
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


_ACC_COLS = ["c_custkey", "n_orders", "avg_order_value", "total_order_value", "c_mktsegment", "n_name", "r_name",
             "negative_balance"]


@register("drop_empty_columns", sql="WITH raw AS (" + Q.RAW_SQL["accounts"] + ")\n" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column, count({c}) AS non_null, count(*) AS rows, count({c}) > 0 AS kept FROM raw"
    for i, c in enumerate(_ACC_COLS)))
def q_drop_empty_columns(spark, sf):
    prof = C.column_profile(raw_cohort(spark, sf, "accounts"))
    return prof.select(F.col("pos").cast("int").alias("pos"), "column", "non_null", "rows",
                       (F.col("non_null") > 0).alias("kept"))


@register("empty_columns_dropped", sql="WITH raw AS (" + Q.RAW_SQL["accounts"] + ")\nSELECT row_number() OVER (ORDER BY pos) - 1 AS pos, column FROM ("
          + " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS column, count({c}) AS n FROM raw" for i, c in enumerate(_ACC_COLS)) + ") WHERE n > 0")
def q_empty_columns_dropped(spark, sf):
    """Columns that stay after two empty ones were planted among them."""
    raw = raw_cohort(spark, sf, "accounts")
    first, *rest = raw.columns
    planted = raw.select(first, F.lit(None).cast("double").alias("empty_number"), *rest, F.lit(None).cast("string").alias("empty_text"))
    return spark.createDataFrame(list(enumerate(C.drop_empty_columns(planted).columns)), "pos long, column string")


_LINE_RAW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice", "l_linestatus",
             "o_orderstatus", "o_orderpriority", "p_brand"]


@register("column_roles", sql="WITH raw AS (" + Q.RAW_SQL["lines"] + ")\n" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column, '{'numeric' if c in LINES.numeric else 'categorical'}' AS role, "
    f"count({c}) AS non_null FROM raw" for i, c in enumerate(_LINE_RAW)))
def q_column_roles(spark, sf):
    raw = raw_cohort(spark, sf, "lines").select(*_LINE_RAW, "returned")
    num, cat = C.column_roles(raw.columns, LINES.numeric, "returned")
    prof = C.column_profile(raw.select(*_LINE_RAW))
    roles = F.when(F.col("column").isin(*num), "numeric").otherwise("categorical")
    return prof.select(F.col("pos").cast("int").alias("pos"), "column", roles.alias("role"), "non_null")


@register("dedupe_rows", sql="SELECT DISTINCT * FROM (" + Q.RAW_SQL["docs"] + ")")
def q_dedupe_rows(spark, sf):
    return C.dedupe_rows(raw_cohort(spark, sf, "docs"))


@register("dedupe_documents", sql="SELECT DISTINCT text, lang, source, n_chars FROM documents")
def q_dedupe_documents(spark, sf):
    """Exact duplicates of whole documents (all columns but the id)."""
    return C.dedupe_rows(table(spark, sf, "documents", ["text", "lang", "source", "n_chars"]))


@register("zero_as_missing", sql="WITH raw AS (" + Q.RAW_SQL["lines"] + ")\n"
          f"SELECT md5({Q.key_text_sql(LINES.key_columns)}) AS row_id, "
          "CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax FROM raw")
def q_zero_as_missing(spark, sf):
    from riskfold.functions.rowid import with_key_row_id
    raw = with_key_row_id(raw_cohort(spark, sf, "lines"), LINES.key_columns)
    return C.zero_as_missing(raw, ["l_discount"]).select("row_id", "l_discount", "l_tax")


@register("clean_target", sql="WITH raw AS (" + Q.RAW_SQL["accounts"] + ")\n" + Q.clean_sql(ACCOUNTS))
def q_clean_target(spark, sf):
    return clean_rows(spark, sf, ACCOUNTS)


_NAME_SQL = """
WITH raw AS ({raw}),
names AS (
  SELECT DISTINCT col_pos, column, value FROM (
    SELECT 0 AS col_pos, 'o_orderstatus' AS column, o_orderstatus AS value FROM raw UNION ALL
    SELECT 1, 'o_orderpriority', o_orderpriority FROM raw UNION ALL
    SELECT 2, 'p_brand', p_brand FROM raw)),
pos AS (SELECT CAST(row_number() OVER (ORDER BY col_pos, value) - 1 AS INTEGER) AS pos,
               column || '_' || value AS name FROM names),
safe AS (SELECT pos, name, regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g') AS s FROM pos)
SELECT pos, name, CASE WHEN k = 0 THEN s ELSE s || '_' || CAST(k AS VARCHAR) END AS safe_name
FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS k FROM safe)
""".format(raw=Q.RAW_SQL["lines"])


@register("sanitize_names", sql=_NAME_SQL)
def q_sanitize_names(spark, sf):
    raw = raw_cohort(spark, sf, "lines")
    cols = ["o_orderstatus", "o_orderpriority", "p_brand"]
    lv = raw.select(F.explode(F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("column"),
                                                 F.col(c).alias("value")) for i, c in enumerate(cols)])).alias("kv"))
    names = lv.select("kv.*").distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("col_pos", "value")   # one row per category: bounded
    names = names.select((F.row_number().over(w) - 1).cast("int").alias("pos"),
                         F.concat(F.col("column"), F.lit("_"), F.col("value")).alias("name"))
    return C.sanitize_name_table(names).select("pos", "name", "safe_name")


# =========================================================================== 2.3 splitting
@register("stratified_split", sql=Q.with_ctes(LINES, "SELECT row_id, returned, split FROM split"))
def q_stratified_split(spark, sf):
    return clean_and_split(spark, sf, LINES, SET).select("row_id", "returned", "split")


@register("stratified_folds", sql=Q.with_ctes(LINES, "SELECT row_id, returned, fold FROM dev"))
def q_stratified_folds(spark, sf):
    dev, _ = _lines_split(spark, sf)
    return dev.select("row_id", "returned", "fold")


_UNSHUF = Q.with_ctes(LINES, """
SELECT d.row_id, d.returned, CAST((SELECT count(*) FROM generate_series(0, 4) AS f(f)
        WHERE d.r >= (SELECT sum(((fo.off + fc.n_class - x.x + 4) // 5) - ((fo.off - x.x + 4) // 5))
                      FROM generate_series(0, 4) AS x(x) WHERE x.x <= f.f)) AS INTEGER) AS fold
FROM (SELECT tr0.*, row_number() OVER (PARTITION BY returned ORDER BY row_id) - 1 AS r FROM tr0) d
JOIN fo ON d.returned = fo.cls JOIN fc ON d.returned = fc.cls""")


@register("folds_unshuffled", sql=_UNSHUF)
def q_folds_unshuffled(spark, sf):
    split = clean_and_split(spark, sf, LINES, SET)
    tr = split.where(F.col("split") == "train")
    return S.stratified_folds(tr, "returned", SET.n_folds, SET.seed, shuffle=False).select("row_id", "returned", "fold")


@register("fold_report", rounded=("train_positive_rate", "validation_positive_rate"), sql=Q.with_ctes(LINES, """
SELECT fold, (SELECT count(*) FROM dev) - count(*) AS n_train, count(*) AS n_validation,
       ((SELECT sum(returned) FROM dev) - sum(returned)) / ((SELECT count(*) FROM dev) - count(*)) AS train_positive_rate,
       sum(returned) / count(*) AS validation_positive_rate
FROM dev GROUP BY fold"""))
def q_fold_report(spark, sf):
    dev, _ = _lines_split(spark, sf)
    return S.fold_report(dev, "returned")


@register("fold_expand", sql=Q.with_ctes(ACCOUNTS, """
SELECT g, row_id, 'train' AS role FROM train UNION ALL SELECT fold AS g, row_id, 'validation' AS role FROM dev"""))
def q_fold_expand(spark, sf):
    dev, _ = dev_and_test(assign(spark, sf, ACCOUNTS, SET))
    return S.fold_expand(dev, SET.n_folds).select(F.col("g").cast("int").alias("g"), "row_id", "role")


@register("inner_folds", sql=Q.with_ctes(ACCOUNTS, """
SELECT d.row_id, CAST((fo2.off + d.r) % (SELECT least(3, min(n_class) // 2) FROM fc) AS INTEGER) AS inner_fold
FROM (SELECT dev.*, row_number() OVER (PARTITION BY negative_balance ORDER BY md5(row_id || '|42'), row_id) - 1 AS r
      FROM dev) d
JOIN (SELECT cls, coalesce(sum(n_class) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM fc) fo2 ON d.negative_balance = fo2.cls"""))
def q_inner_folds(spark, sf):
    dev, _ = dev_and_test(assign(spark, sf, ACCOUNTS, SET))
    return S.inner_folds(dev.drop("fold"), "negative_balance", SET.seed).select("row_id", "inner_fold")


@register("nested_inner_folds", sql=Q.with_ctes(ACCOUNTS, """
SELECT r.o AS outer_fold, r.row_id, CAST((f.off + r.r) % (SELECT least(3, min(n) // 2) FROM oc) AS INTEGER) AS inner_fold
FROM (SELECT o, dev.*, row_number() OVER (PARTITION BY o, negative_balance ORDER BY md5(row_id || '|42'), row_id) - 1 AS r
      FROM dev JOIN outers ON dev.fold <> o) r
JOIN (SELECT o, cls, coalesce(sum(n) OVER (PARTITION BY o ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM oc) f
  ON r.o = f.o AND r.negative_balance = f.cls""", """
outers AS (SELECT DISTINCT CAST(fold AS INTEGER) AS o FROM dev),
oc AS (SELECT o, negative_balance AS cls, count(*) AS n FROM dev JOIN outers ON dev.fold <> o GROUP BY ALL)"""))
def q_nested_inner_folds(spark, sf):
    """Inner folds of every outer fold's training rows."""
    from riskfold.plans.nested import inner_assignment
    dev, _ = dev_and_test(assign(spark, sf, ACCOUNTS, SET))
    inner, _ = inner_assignment(dev, "negative_balance", SET.seed, SET.n_folds)
    return inner.select(F.col("outer").alias("outer_fold"), "row_id", "inner_fold")


@register("clean_and_split", rounded=("avg_order_value", "total_order_value"),
          sql=Q.with_ctes(ACCOUNTS, "SELECT * FROM split"))
def q_clean_and_split(spark, sf):
    return clean_and_split(spark, sf, ACCOUNTS, SET)


@register("class_weights", rounded=("weight",), sql="WITH raw AS (" + Q.RAW_SQL["lines"] + "), clean AS (" +
          Q.clean_sql(LINES) + """)
SELECT returned, count(*) AS n_class, (SELECT count(*) FROM clean) / (2.0 * count(*)) AS weight
FROM clean GROUP BY returned""")
def q_class_weights(spark, sf):
    return P.class_weights(clean_rows(spark, sf, LINES), "returned")


@register("row_weights", rounded=("weight",), sql=Q.with_ctes(LINES, """
SELECT t.g, t.row_id, w.weight FROM train t JOIN (
  SELECT g, returned, sum(count(*)) OVER (PARTITION BY g) / (count(*) OVER (PARTITION BY g) * count(*)) AS weight
  FROM train GROUP BY g, returned) w ON t.g = w.g AND t.returned = w.returned"""))
def q_row_weights(spark, sf):
    dev, _ = _lines_split(spark, sf)
    tr = S.train_view(dev, SET.n_folds)
    cw = P.class_weights(tr, "returned", by=["g"])
    return tr.join(F.broadcast(cw.select("g", "returned", "weight")), ["g", "returned"]) \
             .select(F.col("g").cast("int").alias("g"), "row_id", "weight")


# =========================================================================== 2.4 fit/transform
@register("iqr_bounds", rounded=("q1", "q3", "lower", "upper"),
          sql=Q.with_ctes(LINES, "SELECT g, column, q1, q3, lower, upper FROM bounds", Q.fitted_ctes(LINES)))
def q_iqr_bounds(spark, sf):
    dev, _, _ = _train(spark, sf, LINES)
    return _fences(dev).select(F.col("g").cast("int").alias("g"), "column", "q1", "q3", "lower", "upper")


def _fences(dev):
    """Fences of every fit group; each development row is counted once."""
    return P.iqr_bounds(dev, LINES.iqr_columns, SET.iqr_multiplier, S.fold_fits(SET.n_folds))


@register("iqr_clip", rounded=("l_extendedprice", "p_retailprice"), sql=Q.with_ctes(LINES, """
SELECT a.g, a.row_id,
  CASE WHEN a.l_extendedprice < b.lower__l_extendedprice THEN b.lower__l_extendedprice
       WHEN a.l_extendedprice > b.upper__l_extendedprice THEN b.upper__l_extendedprice ELSE a.l_extendedprice END
       AS l_extendedprice,
  CASE WHEN a.p_retailprice < b.lower__p_retailprice THEN b.lower__p_retailprice
       WHEN a.p_retailprice > b.upper__p_retailprice THEN b.upper__p_retailprice ELSE a.p_retailprice END
       AS p_retailprice
FROM applied a JOIN bwide b ON a.g = b.g""", Q.fitted_ctes(LINES)))
def q_iqr_clip(spark, sf):
    dev, test, tr = _train(spark, sf, LINES)
    bounds = settle(_fences(dev))
    rows = S.apply_view(dev, test)
    out = P.iqr_clip(rows, bounds, LINES.iqr_columns)
    return out.select(F.col("g").cast("int").alias("g"), "row_id", "l_extendedprice", "p_retailprice")


@register("impute_median", rounded=("median",),
          sql=Q.with_ctes(LINES, "SELECT g, column, median FROM med", Q.fitted_ctes(LINES)))
def q_impute_median(spark, sf):
    dev, _, _ = _train(spark, sf, LINES)
    med = P.medians(dev, LINES.numeric, S.fold_fits(SET.n_folds), settle(_fences(dev)))
    return med.select(F.col("g").cast("int").alias("g"), "column", "median")


@register("impute_mode", sql=Q.with_ctes(ACCOUNTS, "SELECT g, column, mode FROM catst", Q.fitted_ctes(ACCOUNTS)))
def q_impute_mode(spark, sf):
    dev, _, _ = _train(spark, sf, ACCOUNTS)
    return P.category_stats(P.category_counts(dev, ACCOUNTS.categorical, S.fold_fits(SET.n_folds))).select(F.col("g").cast("int").alias("g"), "column", "mode")


@register("encode_binary", sql=Q.with_ctes(LINES, """
SELECT g, column, v0, v1, fallback FROM catst WHERE is_binary""", Q.fitted_ctes(LINES)))
def q_encode_binary(spark, sf):
    dev, _, _ = _train(spark, sf, LINES)
    return P.category_stats(P.category_counts(dev, LINES.categorical, S.fold_fits(SET.n_folds))).where("is_binary").select(F.col("g").cast("int").alias("g"), "column", "v0", "v1",
                                            F.col("fallback").cast("int").alias("fallback"))


@register("encode_onehot", sql=Q.with_ctes(ACCOUNTS, """
SELECT g, column, value, feature FROM feats WHERE kind = 'dummy'""", Q.fitted_ctes(ACCOUNTS)))
def q_encode_onehot(spark, sf):
    _, _, _, f = _fitted(spark, sf, ACCOUNTS)
    return f.features.where("kind = 'dummy'").select(F.col("g").cast("int").alias("g"), "column", "value", "feature")


@register("standardise", rounded=("mean", "sd"),
          sql=Q.with_ctes(LINES, "SELECT g, column, mean, sd FROM numst", Q.fitted_ctes(LINES)))
def q_standardise(spark, sf):
    dev, _, tr = _train(spark, sf, LINES, list(LINES.numeric))
    bounds = settle(_fences(dev))
    med = settle(P.medians(dev, LINES.numeric, S.fold_fits(SET.n_folds), bounds))
    num = P.numeric_stats(P.iqr_clip(tr, bounds, LINES.iqr_columns), med, LINES.numeric)
    return num.select(F.col("g").cast("int").alias("g"), "column", "mean", "sd")


@register("preprocess_fit", sql=Q.with_ctes(ACCOUNTS, "SELECT g, pos, feature, kind FROM feats",
                                            Q.fitted_ctes(ACCOUNTS)))
def q_preprocess_fit(spark, sf):
    _, _, _, f = _fitted(spark, sf, ACCOUNTS)
    return f.features.select(F.col("g").cast("int").alias("g"), F.col("pos").cast("int").alias("pos"),
                             "feature", "kind")


@register("preprocess_apply", rounded=("value",), sql=Q.with_ctes(
    ACCOUNTS, Q.transform_long_sql(ACCOUNTS), Q.fitted_ctes(ACCOUNTS)))
def q_preprocess_apply(spark, sf):
    dev, test, _, f = _fitted(spark, sf, ACCOUNTS)
    out = P.transform_long(S.apply_view(dev, test), f)
    return out.select(F.col("g").cast("int").alias("g"), "row_id", "feature", "value")


_PT = "ptrain AS (" + Q.transform_long_sql(ACCOUNTS, "train") + ")"


_PLANTED = {"a": "l_extendedprice", "b": "2 * l_extendedprice + 1000 * l_tax", "c": "l_quantity", "d": "l_quantity + 5 * l_discount", "e": "l_tax", "f": "-l_tax"}


def _planted_prune_sql() -> str:
    """The walk in column order, one step a column."""
    names = list(_PLANTED)
    pairs = ", ".join(f"corr({a}, {b}) AS r_{a}{b}" for i, a in enumerate(names) for b in names[i + 1:])
    steps = [f"x AS (SELECT {', '.join(f'{e}::DOUBLE AS {n}' for n, e in _PLANTED.items())} FROM lineitem)", f"s_ AS (SELECT {pairs} FROM x)"]
    last = "s_"
    for i, n in enumerate(names):
        near = " OR ".join(f"(kept_{m} AND abs(r_{m}{n}) > 0.9)" for m in names[:i]) or "false"
        steps.append(f"s_{n} AS (SELECT *, NOT ({near}) AS kept_{n} FROM {last})")
        last = f"s_{n}"
    return "WITH " + ",\n".join(steps) + "\n" + " UNION ALL ".join(f"SELECT '{n}' AS feature, kept_{n} AS kept FROM {last}" for n in names)


@register("correlation_prune_planted", sql=_planted_prune_sql())
def q_correlation_prune_planted(spark, sf):
    """Columns of which three repeat others but for noise or sign: the walk
    must drop them."""
    rows = table(spark, sf, "lineitem").select(F.lit(0).alias("g"), F.array(*[F.expr(e).cast("double") for e in _PLANTED.values()]).alias("x"))
    found = P.correlated_pairs(rows, P.variances(rows).collect(), {0: list(range(len(_PLANTED)))}, SET.correlation_threshold, tile=2).collect()
    dropped = P.greedy_prune(list(range(len(_PLANTED))), set(), {(r["i"], r["j"]) for r in found})
    return spark.createDataFrame([(n, i not in dropped) for i, n in enumerate(_PLANTED)], "feature string, kept boolean")


@register("variance_filter", rounded=("var_samp",), sql=Q.with_ctes(ACCOUNTS, """
SELECT g, feature, var_samp(value) AS var_samp, var_samp(value) < 0.0001 AS low_variance
FROM ptrain GROUP BY g, feature""", Q.fitted_ctes(ACCOUNTS) + "," + _PT))
def q_variance_filter(spark, sf):
    dev, test, tr, f = _fitted(spark, sf, ACCOUNTS)
    flist = P.global_feature_list(f)
    var = P.variances(P.transform_array(tr, f, flist))
    names = spark.createDataFrame([(i, P.feature_name(*t)) for i, t in enumerate(flist)], "j int, feature string")
    cand = f.features.select("g", "feature")
    return (var.join(F.broadcast(names), "j").join(cand, ["g", "feature"])
               .select(F.col("g").cast("int").alias("g"), "feature", "var_samp",
                       (F.col("var_samp") < F.lit(SET.variance_threshold)).alias("low_variance")))


@register("abs_correlation", rounded=("abs_r",), sql=Q.with_ctes(ACCOUNTS, """
SELECT a.g, a.feature AS feature_a, b.feature AS feature_b, abs(corr(a.value, b.value)) AS abs_r
FROM ptrain a JOIN ptrain b ON a.g = b.g AND a.row_id = b.row_id
JOIN feats fa ON fa.g = a.g AND fa.feature = a.feature JOIN feats fb ON fb.g = b.g AND fb.feature = b.feature
WHERE fa.pos < fb.pos GROUP BY a.g, a.feature, b.feature""", Q.fitted_ctes(ACCOUNTS) + "," + _PT))
def q_abs_correlation(spark, sf):
    dev, test, tr, f = _fitted(spark, sf, ACCOUNTS)
    flist = P.global_feature_list(f)
    _, cor = P.moments(P.gram(P.transform_array(tr, f, flist)))
    names = [(i, P.feature_name(*t)) for i, t in enumerate(flist)]
    na = spark.createDataFrame(names, "i int, feature_a string")
    nb = spark.createDataFrame(names, "j int, feature_b string")
    cand = f.features.select("g", "feature")
    return (cor.join(F.broadcast(na), "i").join(F.broadcast(nb), "j")
               .join(cand.withColumnRenamed("feature", "feature_a"), ["g", "feature_a"])
               .join(cand.withColumnRenamed("feature", "feature_b"), ["g", "feature_b"])
               .select(F.col("g").cast("int").alias("g"), "feature_a", "feature_b", F.abs("r").alias("abs_r")))


def _selector(spark, sf, cohort):
    dev, test, tr, f = _fitted(spark, sf, cohort)
    flist = P.global_feature_list(f)
    sel = P.select_features(f, P.transform_array(tr, f, flist), flist, SET.variance_threshold,
                            SET.correlation_threshold, rows=tr)
    return dev, test, tr, f, flist, sel


@register("correlation_prune", rounded=("var_samp",), sql=Q.with_ctes(
    ACCOUNTS, "SELECT g, pos, feature, var_samp, kept, reason FROM sel",
    Q.fitted_ctes(ACCOUNTS) + "," + Q.selection_ctes(ACCOUNTS)))
def q_correlation_prune(spark, sf):
    *_, sel = _selector(spark, sf, ACCOUNTS)
    return sel.select("g", "pos", "feature", "var_samp", "kept", "reason")


@register("preprocess_folds", rounded=("value",), sql=Q.with_ctes(LINES, f"""
SELECT t.g, t.row_id, k.safe_name AS feature, k.out_pos, t.value
FROM ({Q.transform_long_sql(LINES, "applied")}) t JOIN kept_names k ON k.g = t.g AND k.feature = t.feature""",
    Q.fitted_ctes(LINES) + "," + Q.selection_ctes(LINES)))
def q_preprocess_folds(spark, sf):
    dev, test, tr, f, flist, sel = _selector(spark, sf, LINES)
    # one projection a row: its group's kept features, picked from the array
    keep = P.kept_names(sel).groupBy("g").agg(F.collect_list(F.struct("gpos", "safe_name", "out_pos")).alias("_keep"))
    rows = P.transform_array(S.apply_view(dev, test), f, flist, fill_numeric=False).join(F.broadcast(settle(keep)), "g")
    each = F.transform("_keep", lambda k: F.struct(k["safe_name"].alias("feature"), k["out_pos"].alias("out_pos"),
                                                   F.get("x", k["gpos"]).alias("value")))
    return rows.select(F.col("g").cast("int").alias("g"), "row_id", F.inline(each))


_PROCESSED_SQL = f"""
SELECT a.split, a.fold, t.row_id, a.returned, k.out_pos, k.safe_name AS feature, round(t.value, 6) AS value
FROM ({Q.transform_long_sql(LINES, "applied")}) t JOIN applied a ON a.row_id = t.row_id
JOIN kept_names k ON k.g = t.g AND k.feature = t.feature"""
_PROCESSED_CTES = Q.fitted_ctes(LINES) + "," + Q.selection_ctes(LINES)


@register("process_dataset", sql=Q.with_ctes(LINES, _PROCESSED_SQL, _PROCESSED_CTES, full_fit=True))
def q_process_dataset(spark, sf):
    from riskfold.plans.process import process_dataset
    return process_dataset(spark, sf, LINES, SET)


# =========================================================================== 2.7 metrics
from riskfold.operators import metrics as M  # noqa: E402

MODELS = (("discount", "Discount score"), ("tax", "Tax score"), ("quantity", "Quantity score"))


def _model_score(key: str) -> F.Column:
    return {"discount": F.coalesce(F.col("l_discount"), F.lit(0.0)) * 10.0,
            "tax": F.col("l_tax") * 12.5,
            "quantity": F.col("l_quantity") / 50.0}[key]


#: Columns that ``score_table`` reads besides row id and target.
_SCORED = ["o_orderstatus", "l_discount", "l_tax", "l_quantity"]


def score_table(rows: DataFrame) -> DataFrame:
    """(dataset_key, dataset_name, model_key, model_name, fold, row_id, y,
    score): three datasets (order status) x three scoring rules."""
    models = F.array(*[F.struct(F.lit(k).alias("model_key"), F.lit(n).alias("model_name"),
                                _model_score(k).alias("score")) for k, n in MODELS])
    return rows.select(
        F.concat(F.lit("status_"), F.col("o_orderstatus")).alias("dataset_key"),
        F.concat(F.lit("Order status "), F.col("o_orderstatus")).alias("dataset_name"),
        "fold", "row_id", F.col("returned").alias("y"), F.explode(models).alias("m")) \
        .select("dataset_key", "dataset_name", "m.model_key", "m.model_name", "fold", "row_id", "y",
                F.col("m.score").alias("score"))


def _scores(spark, sf):
    a = assign(spark, sf, LINES, SET, _SCORED)
    dev, test = dev_and_test(a)
    return score_table(dev), score_table(test)


_FK = ["dataset_key", "dataset_name", "model_key", "model_name", "fold"]
_MSQL = lambda body: Q.with_ctes(LINES, body, Q.fold_metrics_ctes())


@register("roc_auc", rounded=("roc_auc",), sql=_MSQL(f"SELECT {Q.KEYS_SQL}, fold, roc_auc FROM fm"))
def q_roc_auc(spark, sf):
    s, _ = _scores(spark, sf)
    return M.auc_metrics(M.score_counts(s, _FK), _FK).select(*_FK, "roc_auc")


@register("pr_auc", rounded=("pr_auc",), sql=_MSQL(f"SELECT {Q.KEYS_SQL}, fold, pr_auc FROM fm"))
def q_pr_auc(spark, sf):
    s, _ = _scores(spark, sf)
    return M.auc_metrics(M.score_counts(s, _FK), _FK).select(*_FK, "pr_auc")


@register("threshold_metrics", rounded=("recall", "f1"),
          sql=_MSQL(f"SELECT {Q.KEYS_SQL}, fold, recall, f1 FROM fm_thr"))
def q_threshold_metrics(spark, sf):
    s, _ = _scores(spark, sf)
    return M.threshold_metrics(s, _FK, SET.threshold)


@register("metric_guards", sql=_MSQL(f"""
SELECT {Q.KEYS_SQL}, fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
       count(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) AS n_bad_label,
       count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS n_bad_score,
       sum(y) > 0 AND count(*) - sum(y) > 0 AS ok FROM scores GROUP BY ALL"""))
def q_metric_guards(spark, sf):
    s, _ = _scores(spark, sf)
    return M.metric_guards(s, _FK)


@register("roc_points", rounded=("threshold", "fpr", "tpr"), sql=_MSQL(f"""
SELECT {Q.KEYS_SQL}, fold, score AS threshold, (fp_before + neg) / n_neg AS fpr, (tp_before + pos) / n_pos AS tpr
FROM fm_cum UNION ALL
SELECT DISTINCT {Q.KEYS_SQL}, fold, NULL AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM scores"""))
def q_roc_points(spark, sf):
    s, _ = _scores(spark, sf)
    return M.roc_points(M.score_counts(s, _FK), _FK)


_FMR = ("train_positive_rate", "validation_positive_rate", "roc_auc", "pr_auc", "recall", "f1")


@register("fold_metrics", rounded=_FMR, sql=_MSQL("SELECT * FROM fold_metrics"))
def q_fold_metrics(spark, sf):
    s, _ = _scores(spark, sf)
    return M.fold_metrics(s, SET.threshold)


_SUMR = tuple(f"{m}_{s}" for m in M.METRICS for s in ("mean", "std", "min", "max", "range"))


@register("cv_summary", rounded=_SUMR, sql=_MSQL("SELECT * FROM cv_summary"))
def q_cv_summary(spark, sf):
    s, _ = _scores(spark, sf)
    return M.cv_summary(M.fold_metrics(s, SET.threshold))


@register("dataset_ranks", rounded=("pr_auc_mean", "roc_auc_mean", "f1_mean", "pr_auc_std"), sql=_MSQL(
    "SELECT dataset_key, model_key, pr_auc_mean, roc_auc_mean, f1_mean, pr_auc_std, cv_rank FROM mranked"))
def q_dataset_ranks(spark, sf):
    s, _ = _scores(spark, sf)
    r = M.dataset_ranks(M.cv_summary(M.fold_metrics(s, SET.threshold)), SET.primary_metric)
    return r.select("dataset_key", "model_key", "pr_auc_mean", "roc_auc_mean", "f1_mean", "pr_auc_std", "cv_rank")


_OVR = ("mean_dataset_rank",) + tuple(f"{m}_{s}" for s in ("mean", "std") for m in M.METRICS)


@register("overall_comparison", rounded=_OVR, sql=_MSQL(
    "SELECT model_key, model_name, avg(cv_rank) AS mean_dataset_rank, "
    + ", ".join(f"avg({m}_mean) AS {m}_mean" for m in M.METRICS) + ", "
    + ", ".join(f"avg({m}_std) AS {m}_std" for m in M.METRICS) + " FROM mranked GROUP BY model_key, model_name"))
def q_overall_comparison(spark, sf):
    s, _ = _scores(spark, sf)
    return M.overall_comparison(M.dataset_ranks(M.cv_summary(M.fold_metrics(s, SET.threshold))))


_CMPR = tuple(f"{m}_mean" for m in M.METRICS) + tuple(f"test_{m}" for m in M.METRICS)


@register("model_comparison", rounded=_CMPR, sql=_MSQL(
    "SELECT r.dataset_key, r.model_key, r.cv_rank, " + ", ".join(f"r.{m}_mean" for m in M.METRICS) + ", "
    + ", ".join(f"t.{m} AS test_{m}" for m in M.METRICS)
    + " FROM mranked r LEFT JOIN test_metrics t ON r.dataset_key = t.dataset_key AND r.model_key = t.model_key"))
def q_model_comparison(spark, sf):
    s, t = _scores(spark, sf)
    keys = ["dataset_key", "dataset_name", "model_key", "model_name"]
    ranked = M.dataset_ranks(M.cv_summary(M.fold_metrics(s, SET.threshold)))
    test = M.binary_metrics(t, keys, SET.threshold)
    out = M.model_comparison(ranked, test)
    return out.select("dataset_key", "model_key", "cv_rank", *[f"{m}_mean" for m in M.METRICS],
                      *[f"test_{m}" for m in M.METRICS])


@register("dataset_overview", sql=Q.with_ctes(LINES, """
SELECT d.dataset_key, d.n_development, t.n_test, round_even(100.0 * d.pos / d.n_development, 2) AS development_positive_pct,
       round_even(100.0 * t.pos / t.n_test, 2) AS test_positive_pct
FROM (SELECT 'status_' || o_orderstatus AS dataset_key, count(*) AS n_development, sum(returned) AS pos FROM dev GROUP BY 1) d
JOIN (SELECT 'status_' || o_orderstatus AS dataset_key, count(*) AS n_test, sum(returned) AS pos FROM test GROUP BY 1) t
USING (dataset_key)"""))
def q_dataset_overview(spark, sf):
    a = assign(spark, sf, LINES, SET, ["o_orderstatus"])
    k = F.concat(F.lit("status_"), F.col("o_orderstatus")).alias("dataset_key")
    agg = a.groupBy(k).agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("long").alias("n_development"),
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).cast("long").alias("n_test"),
        F.sum(F.when(F.col("split") == "train", F.col("returned")).otherwise(0)).alias("_dp"),
        F.sum(F.when(F.col("split") == "test", F.col("returned")).otherwise(0)).alias("_tp"))
    return agg.select("dataset_key", "n_development", "n_test",
                      F.bround(100.0 * F.col("_dp") / F.col("n_development"), 2).alias("development_positive_pct"),
                      F.bround(100.0 * F.col("_tp") / F.col("n_test"), 2).alias("test_positive_pct"))


@register("rq_tables", sql=_MSQL(
    "SELECT dataset_key, model_key, cv_rank, " + ", ".join(
        f"round_even({m}_mean, 4) AS {m}_mean, round_even({m}_std, 4) AS {m}_std" for m in M.METRICS)
    + " FROM mranked"))
def q_rq_tables(spark, sf):
    s, _ = _scores(spark, sf)
    r = M.dataset_ranks(M.cv_summary(M.fold_metrics(s, SET.threshold)))
    return r.select("dataset_key", "model_key", "cv_rank",
                    *[F.bround(F.col(f"{m}_{x}"), 4).alias(f"{m}_{x}") for m in M.METRICS for x in ("mean", "std")])


@register("best_by_metric", rounded=("value",), sql=_MSQL("""
SELECT metric, dataset_key, model_key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, dataset_key, model_key) AS k FROM (
    UNPIVOT (SELECT dataset_key, model_key, roc_auc_mean, pr_auc_mean, recall_mean, f1_mean FROM cv_summary)
    ON roc_auc_mean, pr_auc_mean, recall_mean, f1_mean INTO NAME metric VALUE value)) WHERE k = 1"""))
def q_best_by_metric(spark, sf):
    s, _ = _scores(spark, sf)
    summ = M.cv_summary(M.fold_metrics(s, SET.threshold))
    cols = [f"{m}_mean" for m in M.METRICS]
    lv = summ.select("dataset_key", "model_key", *cols).unpivot(["dataset_key", "model_key"], cols, "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "dataset_key", "model_key")
    return lv.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


@register("fold_pivot", rounded=tuple(f"fold_{i}" for i in range(SET.n_folds)), sql=_MSQL(
    "SELECT dataset_key, model_key, " + ", ".join(f"avg(CASE WHEN fold = {i} THEN pr_auc END) AS fold_{i}"
                                                  for i in range(SET.n_folds))
    + " FROM fold_metrics GROUP BY dataset_key, model_key"))
def q_fold_pivot(spark, sf):
    s, _ = _scores(spark, sf)
    fm = M.fold_metrics(s, SET.threshold)
    p = fm.groupBy("dataset_key", "model_key").pivot("fold", list(range(SET.n_folds))).agg(F.avg("pr_auc"))
    return p.select("dataset_key", "model_key", *[F.col(str(i)).alias(f"fold_{i}") for i in range(SET.n_folds)])


@register("dataset_variability", rounded=tuple(f"{m}_std" for m in M.METRICS), sql=_MSQL(
    "SELECT dataset_key, " + ", ".join(f"avg({m}_std) AS {m}_std" for m in M.METRICS)
    + " FROM cv_summary GROUP BY dataset_key"))
def q_dataset_variability(spark, sf):
    s, _ = _scores(spark, sf)
    summ = M.cv_summary(M.fold_metrics(s, SET.threshold))
    return summ.groupBy("dataset_key").agg(*[F.avg(f"{m}_std").alias(f"{m}_std") for m in M.METRICS])


# =========================================================================== 2.8 attribution ranking stability
from riskfold.operators import stability as ST  # noqa: E402

IMP_MODELS = (("mean_abs", "Mean absolute value"), ("rms", "Root mean square"))


def importance_frame(spark, sf) -> DataFrame:
    """Importance frame from ``embeddings``: fold = label, feature = vector
    position, importance = mean |x| or root mean square per (fold, position)."""
    e = table(spark, sf, "embeddings", ["label", "embedding"])
    x = e.select(F.col("label").alias("fold"), F.posexplode("embedding").alias("pos", "x")) \
         .withColumn("x", F.col("x").cast("double"))
    agg = x.groupBy("fold", "pos").agg(F.avg(F.abs("x")).alias("mean_abs"),
                                       F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    models = F.array(*[F.struct(F.lit(k).alias("model_key"), F.lit(n).alias("model_name"), F.col(k).alias("v"))
                       for k, n in IMP_MODELS])
    imp = agg.select("fold", F.format_string("f%02d", F.col("pos")).alias("feature"), F.explode(models).alias("m")) \
             .select(F.lit("embeddings").alias("dataset_key"), F.lit("Embedding vectors").alias("dataset_name"),
                     "m.model_key", "m.model_name", "fold", "feature", F.col("m.v").alias("mean_abs_shap"))
    return ST.importance_ranks(imp)


_IMP = lambda body, extra="": "WITH " + Q.IMP_CTES + extra + "\n" + body
_PW = lambda body: "WITH " + Q.pairwise_ctes(SET.top_k) + "\n" + body


@register("feature_importance", rounded=("mean_abs_shap",), sql=_IMP("SELECT * FROM imp"))
def q_feature_importance(spark, sf):
    return importance_frame(spark, sf)


@register("attribution_log", sql=f"""
SELECT 'embeddings' AS dataset_key, m.model_key, label AS fold, m.model_key AS explainer,
       count(*) AS n_explained, CAST(0 AS BIGINT) AS n_background, max(len(embedding)) AS n_features
FROM embeddings, (VALUES ('mean_abs'), ('rms')) AS m(model_key) GROUP BY m.model_key, label""")
def q_attribution_log(spark, sf):
    e = table(spark, sf, "embeddings", ["label", "embedding"])
    g = e.groupBy(F.col("label").alias("fold")).agg(F.count(F.lit(1)).alias("n_explained"),
                                                     F.max(F.size("embedding")).alias("n_features"))
    models = F.array(*[F.lit(k) for k, _ in IMP_MODELS])
    return g.select(F.lit("embeddings").alias("dataset_key"), F.explode(models).alias("model_key"), "fold",
                    "n_explained", "n_features") \
            .select("dataset_key", "model_key", "fold", F.col("model_key").alias("explainer"), "n_explained",
                    F.lit(0).cast("long").alias("n_background"), "n_features")


@register("pairwise_spearman", rounded=("spearman_rho",),
          sql=_PW(f"SELECT {Q.GK_SQL}, fold_a, fold_b, n_features, rho AS spearman_rho FROM sp"))
def q_pairwise_spearman(spark, sf):
    pairs = ST.fold_pairs(_first_imp(spark, sf), SET.top_k)
    return ST.pairwise_spearman(pairs).drop("_pa", "_pb")


def _first_imp(spark, sf):
    return importance_frame(spark, sf)


@register("pairwise_kendall", rounded=("kendall_tau",),
          sql=_PW("SELECT dataset_key, model_key, fold_a, fold_b, tau AS kendall_tau FROM kd"))
def q_pairwise_kendall(spark, sf):
    pairs = ST.fold_pairs(_first_imp(spark, sf), SET.top_k)
    return ST.pairwise_kendall(pairs).select("dataset_key", "model_key", "fold_a", "fold_b", "kendall_tau")


@register("topk_jaccard", rounded=("top_k_jaccard",),
          sql=_PW("SELECT dataset_key, model_key, fold_a, fold_b, top_k, jac AS top_k_jaccard FROM jc"))
def q_topk_jaccard(spark, sf):
    pairs = ST.fold_pairs(_first_imp(spark, sf), SET.top_k)
    return ST.topk_jaccard(pairs, SET.top_k).select("dataset_key", "model_key", "fold_a", "fold_b", "top_k",
                                                    "top_k_jaccard")


@register("rank_guards", sql=_IMP("""
SELECT dataset_key, model_key, fold, count(*) AS n_rows, count(DISTINCT feature) AS n_features,
       count(*) = count(DISTINCT feature) AS unique_features FROM imp GROUP BY dataset_key, model_key, fold"""))
def q_rank_guards(spark, sf):
    imp = _first_imp(spark, sf)
    ST._check(imp, SET.top_k)
    return imp.groupBy("dataset_key", "model_key", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("feature").alias("n_features")) \
        .withColumn("unique_features", F.col("n_rows") == F.col("n_features"))


@register("pairwise_stability", rounded=("kendall_tau", "spearman_rho", "top_k_jaccard"), sql=_PW("SELECT * FROM pw"))
def q_pairwise_stability(spark, sf):
    return ST.pairwise_stability(_first_imp(spark, sf), SET.top_k)


_STS = tuple(f"{n}_{s}" for n in ("kendall_tau", "spearman", "top_k_jaccard") for s in ("mean", "std", "min", "max"))


@register("stability_summary", rounded=_STS, sql=_PW(f"""
SELECT {Q.GK_SQL}, top_k, count(*) AS pair_count, any_value(n_features) AS n_features,
  """ + ", ".join(f"avg({c}) AS {n}_mean, coalesce(stddev_samp({c}), 0.0) AS {n}_std, min({c}) AS {n}_min, "
                  f"max({c}) AS {n}_max" for c, n in (("kendall_tau", "kendall_tau"), ("spearman_rho", "spearman"),
                                                      ("top_k_jaccard", "top_k_jaccard"))) + """,
  CAST(round((1 + sqrt(1 + 8 * count(*))) / 2) AS INTEGER) AS n_folds
FROM pw GROUP BY dataset_key, dataset_name, model_key, model_name, top_k"""))
def q_stability_summary(spark, sf):
    return ST.stability_summary(ST.pairwise_stability(_first_imp(spark, sf), SET.top_k))


@register("consensus_ranking", rounded=("mean_abs_shap", "mean_rank", "rank_std", "top_k_frequency"), sql=_IMP(f"""
SELECT {Q.GK_SQL}, feature, mean_abs_shap, mean_rank, rank_std, top_k_frequency, folds_observed,
       row_number() OVER (PARTITION BY dataset_key, model_key ORDER BY mean_rank, feature) AS consensus_rank
FROM (SELECT {Q.GK_SQL}, feature, avg(mean_abs_shap) AS mean_abs_shap, avg(rank) AS mean_rank,
             stddev_samp(rank) AS rank_std, avg(CASE WHEN rank <= {SET.top_k} THEN 1.0 ELSE 0.0 END) AS top_k_frequency,
             count(DISTINCT fold) AS folds_observed FROM imp GROUP BY {Q.GK_SQL}, feature)"""))
def q_consensus_ranking(spark, sf):
    return ST.consensus_ranking(_first_imp(spark, sf), SET.top_k)


@register("rank_matrix", rounded=("rank",), sql=_IMP(f"""
SELECT m.*, o.feature_order FROM
  (SELECT {Q.GK_SQL}, fold, feature, avg(rank) AS rank FROM imp GROUP BY {Q.GK_SQL}, fold, feature) m
JOIN (SELECT dataset_key, model_key, feature, row_number() OVER (PARTITION BY dataset_key, model_key
             ORDER BY avg(rank), avg(mean_abs_shap) DESC, feature) AS feature_order
      FROM imp GROUP BY dataset_key, model_key, feature) o USING (dataset_key, model_key, feature)"""))
def q_rank_matrix(spark, sf):
    return ST.rank_matrix(_first_imp(spark, sf))


@register("fold_correlation_matrix", rounded=("value",), sql=_PW(f"""
SELECT {Q.GK_SQL}, fold_a, fold_b, rho AS value FROM sp UNION ALL
SELECT {Q.GK_SQL}, fold_b AS fold_a, fold_a AS fold_b, rho AS value FROM sp UNION ALL
SELECT DISTINCT {Q.GK_SQL}, fold AS fold_a, fold AS fold_b, 1.0 AS value FROM imp"""))
def q_fold_correlation_matrix(spark, sf):
    imp = _first_imp(spark, sf)
    pw = ST.shared_correlations(imp)
    return ST.fold_correlation_matrix(pw, imp.select(*ST.GK, "fold").distinct(), "value")


@register("fold_kendall_matrix", rounded=("value",), sql=_PW(f"""
SELECT {Q.GK_SQL}, fold_a, fold_b, kendall_tau AS value FROM pw UNION ALL
SELECT {Q.GK_SQL}, fold_b AS fold_a, fold_a AS fold_b, kendall_tau AS value FROM pw UNION ALL
SELECT DISTINCT {Q.GK_SQL}, fold AS fold_a, fold AS fold_b, 1.0 AS value FROM imp"""))
def q_fold_kendall_matrix(spark, sf):
    imp = _first_imp(spark, sf)
    pw = ST.shared_correlations(imp, "kendall")
    return ST.fold_correlation_matrix(pw, imp.select(*ST.GK, "fold").distinct(), "value")


_OV = _IMP(f"""
SELECT a.dataset_key, a.dataset_name, a.model_key, a.model_name, a.fold AS fold_a, b.fold AS fold_b,
       1 - 6 * sum((a.rank - b.rank) * (a.rank - b.rank)) / (count(*) * (count(*) * count(*) - 1)) AS spearman,
       sum(CASE WHEN a.rank <= 3 AND b.rank <= 3 THEN 1 ELSE 0 END) / 3.0 AS overlap
FROM imp a JOIN imp b ON a.dataset_key = b.dataset_key AND a.model_key = b.model_key AND a.feature = b.feature
     AND a.fold < b.fold
GROUP BY a.dataset_key, a.dataset_name, a.model_key, a.model_name, a.fold, b.fold""")


@register("ranking_overlap", rounded=("spearman", "overlap"), sql=_OV)
def q_ranking_overlap(spark, sf):
    return ST.ranking_overlap(ST.ranking_lists(_first_imp(spark, sf)), 3)


@register("ranking_stability", rounded=("spearman", "top_k_overlap"), sql=
          "WITH ov AS (" + _OV + f""")
SELECT {Q.GK_SQL}, avg(spearman) AS spearman, avg(overlap) AS top_k_overlap,
       CAST(count(DISTINCT fold_a) + 1 AS DOUBLE) AS n_rankings FROM ov GROUP BY {Q.GK_SQL}""")
def q_ranking_stability(spark, sf):
    lists = ST.ranking_lists(_first_imp(spark, sf))
    return ST.ranking_stability(ST.ranking_overlap(lists, 3), lists)


# =========================================================================== 2.5 exploratory aggregates
from riskfold.operators import profile as PR  # noqa: E402

_RAWL = lambda body: "WITH raw AS (" + Q.RAW_SQL["lines"] + ")\n" + body
_RAWA = lambda body: "WITH raw AS (" + Q.RAW_SQL["accounts"] + ")\n" + body
_NUML = list(LINES.numeric)
_ACC_TYPES = {"c_custkey": "bigint", "n_orders": "double", "avg_order_value": "double", "total_order_value": "double",
              "c_mktsegment": "string", "n_name": "string", "r_name": "string", "negative_balance": "string"}


@register("table_profile", sql=_RAWA(" UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column, '{_ACC_TYPES[c]}' AS dtype, count({c}) AS non_null, count(*) AS rows "
    f"FROM raw" for i, c in enumerate(_ACC_COLS))))
def q_table_profile(spark, sf):
    raw = raw_cohort(spark, sf, "accounts")
    types = spark.createDataFrame([(c, t) for c, t in raw.dtypes], "column string, dtype string")
    prof = C.column_profile(raw)
    return prof.join(F.broadcast(types), "column").select(F.col("pos").cast("int").alias("pos"), "column", "dtype",
                                                          "non_null", "rows")


@register("missing_profile", sql=_RAWA(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing, "
        f"round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS pct_missing FROM raw" for c in _ACC_COLS)
    + ") WHERE n_missing > 0"))
def q_missing_profile(spark, sf):
    return PR.missing_profile(raw_cohort(spark, sf, "accounts"), _ACC_COLS)


@register("describe_numeric", rounded=("mean", "std", "min", "q25", "q50", "q75", "max"), sql=_RAWL(
    "SELECT column, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
    "quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, "
    f"max(value) AS max FROM ({Q.unpivot_sql('raw', [], _NUML)}) GROUP BY column".replace("SELECT , ", "SELECT ")))
def q_describe_numeric(spark, sf):
    return PR.describe_numeric(raw_cohort(spark, sf, "lines"), _NUML)


@register("value_counts", rounded=("pct",), sql=_RAWL("""
SELECT column, value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY column) AS pct FROM (
  SELECT 'o_orderpriority' AS column, o_orderpriority AS value FROM raw UNION ALL
  SELECT 'p_brand', p_brand FROM raw) WHERE value IS NOT NULL GROUP BY column, value"""))
def q_value_counts(spark, sf):
    return PR.value_counts(raw_cohort(spark, sf, "lines"), ["o_orderpriority", "p_brand"])


@register("correlation_matrix", rounded=("r",), sql=_RAWL(" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM raw"
    for i, a in enumerate(_NUML) for b in _NUML[i + 1:])))
def q_correlation_matrix(spark, sf):
    return PR.correlation_matrix(raw_cohort(spark, sf, "lines"), _NUML)


@register("rate_by_category", rounded=("rate",), sql=_RAWA("""
SELECT c_mktsegment, count(*) AS n, 100.0 * avg(CASE WHEN negative_balance = 'Yes' THEN 1.0 ELSE 0.0 END) AS rate
FROM raw WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment"""))
def q_rate_by_category(spark, sf):
    return PR.rate_by_category(raw_cohort(spark, sf, "accounts"), "c_mktsegment", "negative_balance")


@register("box_stats", rounded=("q1", "median", "q3", "whisker_low", "whisker_high"), sql=_RAWL("""
SELECT r.o_orderpriority, q.q1, q.median, q.q3,
       min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
       max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high,
       count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1))
         AS n_outliers
FROM raw r JOIN (SELECT o_orderpriority, quantile_cont(l_extendedprice, 0.25) AS q1,
                        quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
                 FROM raw GROUP BY o_orderpriority) q USING (o_orderpriority)
GROUP BY r.o_orderpriority, q.q1, q.median, q.q3"""))
def q_box_stats(spark, sf):
    return PR.box_stats(raw_cohort(spark, sf, "lines"), "l_extendedprice", "o_orderpriority")


@register("zero_counts", rounded=("pct_zero",), sql=_RAWL(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} = 0) AS n_zero, "
    f"100.0 * count(*) FILTER (WHERE {c} = 0) / count(*) AS pct_zero FROM raw" for c in ("l_discount", "l_tax"))))
def q_zero_counts(spark, sf):
    return PR.zero_counts(raw_cohort(spark, sf, "lines"), ["l_discount", "l_tax"])


@register("outlier_counts", rounded=("lower", "upper"), sql="WITH raw AS (" + Q.RAW_SQL["lines"] + "), clean AS ("
          + Q.clean_sql(LINES) + "), lv AS (" + Q.unpivot_sql("clean", ["row_id"], ["l_extendedprice", "l_discount"])
          + """), q AS (SELECT column, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
       quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper
       FROM lv WHERE value IS NOT NULL GROUP BY column)
SELECT column, lower, upper, count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers
FROM lv JOIN q USING (column) GROUP BY column, lower, upper""")
def q_outlier_counts(spark, sf):
    return PR.outlier_counts(clean_rows(spark, sf, LINES), ["l_extendedprice", "l_discount"], SET.iqr_multiplier)


@register("duplicate_count", rounded=("pct_duplicates",), sql="WITH raw AS (" + Q.RAW_SQL["docs"] + """)
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS n_duplicates,
       100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw))) / count(*) AS pct_duplicates FROM raw""")
def q_duplicate_count(spark, sf):
    return PR.duplicate_count(raw_cohort(spark, sf, "docs"))


@register("duplicate_documents", rounded=("pct_duplicates",), sql="""
SELECT count(*) AS n_rows, count(*) - count(DISTINCT h) AS n_duplicates, 100.0 * (count(*) - count(DISTINCT h)) / count(*) AS pct_duplicates
FROM (SELECT md5(coalesce(text, '') || '|' || (text IS NULL) || '|' || coalesce(lang, '') || '|' || (lang IS NULL) || '|' || coalesce(source, '') || '|' || (source IS NULL)) AS h
      FROM documents)""")
def q_duplicate_documents(spark, sf):
    """All documents, whole texts: rows that repeat an earlier text, language and source."""
    return PR.duplicate_count(table(spark, sf, "documents", ["text", "lang", "source"]))


# =========================================================================== 2.9 declared with a test
from riskfold.operators import checks as CK  # noqa: E402

EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]
_ENT = ["n_events"] + [f"{k}_{s}" for k in EVENT_KINDS for s in ("mean", "std", "min", "max")]


@register("entity_aggregates", rounded=tuple(c for c in _ENT if c != "n_events"), sql=(
    "SELECT user_id, count(*) AS n_events, " + ", ".join(
        f"avg(value) FILTER (WHERE event_type = '{k}') AS {k}_mean, "
        f"stddev_samp(value) FILTER (WHERE event_type = '{k}') AS {k}_std, "
        f"min(value) FILTER (WHERE event_type = '{k}') AS {k}_min, "
        f"max(value) FILTER (WHERE event_type = '{k}') AS {k}_max" for k in EVENT_KINDS)
    + " FROM events GROUP BY user_id"))
def q_entity_aggregates(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "event_type", "value"])
    return CK.entity_aggregates(ev, "user_id", "event_type", "value", EVENT_KINDS)


@register("entity_features", rounded=tuple(c for c in _ENT if c != "n_events"), sql=(
    "SELECT c_custkey, c_mktsegment, " + ", ".join(f"a.{c}" for c in _ENT) + " FROM customer LEFT JOIN ("
    "SELECT user_id, count(*) AS n_events, " + ", ".join(
        f"avg(value) FILTER (WHERE event_type = '{k}') AS {k}_mean, "
        f"stddev_samp(value) FILTER (WHERE event_type = '{k}') AS {k}_std, "
        f"min(value) FILTER (WHERE event_type = '{k}') AS {k}_min, "
        f"max(value) FILTER (WHERE event_type = '{k}') AS {k}_max" for k in EVENT_KINDS)
    + " FROM events GROUP BY user_id) a ON c_custkey = a.user_id"))
def q_entity_features(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "event_type", "value"])
    agg = CK.entity_aggregates(ev, "user_id", "event_type", "value", EVENT_KINDS)
    cu = table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    return cu.join(agg, cu.c_custkey == agg.user_id, "left").select("c_custkey", "c_mktsegment", *_ENT)


_LFEAT = list(LINES.numeric) + list(LINES.categorical)


@register("leakage_checks", sql="WITH raw AS (" + Q.RAW_SQL["lines"] + "), clean AS (" + Q.clean_sql(LINES) + ")\n"
          + " UNION ALL ".join(
              f"SELECT '{c}' AS feature, {'true' if c.endswith('_id') else 'false'} AS id_like, '{c}' = 'returned' AS is_target, "
              f"bool_and(coalesce(TRY_CAST({c} AS DOUBLE) = CAST(returned AS DOUBLE), false)) AS equals_target FROM clean"
              for c in [*_LFEAT, "returned", "copy_id"]).replace("TRY_CAST(copy_id AS", "TRY_CAST(returned AS"))
def q_leakage_checks(spark, sf):
    """With two offenders planted among the features: the target itself, and
    its copy under an identifier's name."""
    rows = clean_rows(spark, sf, LINES).withColumn("copy_id", F.col("returned"))
    return CK.leakage_checks(rows, "returned", [*_LFEAT, "returned", "copy_id"])


@register("split_overlap", sql=Q.with_ctes(LINES, f"""
SELECT CAST(sum(least(tr, te)) AS BIGINT) AS n_overlap, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
       sum(least(tr, te)) <= sum(c - 1) AS ok FROM (
  SELECT count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'test') AS te, count(*) AS c
  FROM split GROUP BY {', '.join(_LFEAT + ['returned'])})"""))
def q_split_overlap(spark, sf):
    return CK.split_overlap(clean_and_split(spark, sf, LINES, SET), _LFEAT + ["returned"])


@register("leakage_probe", rounded=("fitted", "train_stat", "full_stat"), sql=Q.with_ctes(ACCOUNTS, """
SELECT m.column, m.median AS fitted, t.v AS train_stat, f.v AS full_stat,
       m.median = t.v AS equals_train, m.median <> f.v AS differs_full FROM med m
JOIN (SELECT column, quantile_cont(value, 0.5) AS v FROM (""" + Q.unpivot_sql("dev", ["row_id"], ACCOUNTS.numeric)
    + """) WHERE value IS NOT NULL GROUP BY column) t USING (column)
JOIN (SELECT column, quantile_cont(value, 0.5) AS v FROM (""" + Q.unpivot_sql("clean", ["row_id"], ACCOUNTS.numeric)
    + """) WHERE value IS NOT NULL GROUP BY column) f USING (column)
WHERE m.g = -1""", Q.fitted_ctes(ACCOUNTS)))
def q_leakage_probe(spark, sf):
    from riskfold.functions.quantiles import exact_quantiles
    dev, test, _, f = _fitted(spark, sf, ACCOUNTS)
    allrows = dev.unionByName(test)
    num = list(ACCOUNTS.numeric)
    tr = exact_quantiles(P.long_values(dev, [], num), ["column"], "value", [0.5]).select("column", F.col("q").alias("train_stat"))
    fu = exact_quantiles(P.long_values(allrows, [], num), ["column"], "value", [0.5]).select("column", F.col("q").alias("full_stat"))
    m = f.num.where("g = -1").select("column", F.col("median").alias("fitted"))
    return m.join(tr, "column").join(fu, "column").select(
        "column", "fitted", "train_stat", "full_stat", (F.col("fitted") == F.col("train_stat")).alias("equals_train"),
        (F.col("fitted") != F.col("full_stat")).alias("differs_full"))


@register("validate_split", sql=Q.with_ctes(LINES, """
SELECT check_name AS "check", CAST(n_violations AS BIGINT) AS n_violations, n_violations = 0 AS ok FROM (
  SELECT 'null_target' AS check_name,
         (SELECT count(*) FROM (SELECT split, row_id, any_value(returned) AS t FROM processed GROUP BY split, row_id)
          WHERE t IS NULL) AS n_violations
  UNION ALL SELECT 'bad_label',
         (SELECT count(*) FROM (SELECT split, row_id, any_value(returned) AS t FROM processed GROUP BY split, row_id)
          WHERE t NOT IN (0, 1))
  UNION ALL SELECT 'feature_mismatch',
         (SELECT count(*) FROM (SELECT feature, count(DISTINCT split) AS s FROM processed GROUP BY feature)
          WHERE s <> (SELECT count(DISTINCT split) FROM processed))
  UNION ALL SELECT 'null_value', (SELECT count(*) FROM processed WHERE value IS NULL))""",
    _PROCESSED_CTES + ",\nprocessed AS (" + _PROCESSED_SQL + ")", full_fit=True))
def q_validate_split(spark, sf):
    from riskfold.plans.process import process_dataset
    return CK.validate_split(process_dataset(spark, sf, LINES, SET), "returned")


@register("validate_folds", sql=Q.with_ctes(LINES, f"""
SELECT * FROM (VALUES ('missing_fold', (SELECT count(*) FROM dev WHERE fold IS NULL)),
                      ('unknown_row', (SELECT count(*) FROM dev WHERE row_id NOT IN (SELECT row_id FROM clean))),
                      ('duplicate_row', (SELECT count(*) FROM (SELECT row_id FROM dev GROUP BY row_id HAVING count(*) > 1))),
                      ('fold_count_off', (SELECT abs(count(DISTINCT fold) - {SET.n_folds}) FROM dev)),
                      ('empty_side', (SELECT CASE WHEN count(DISTINCT fold) < 2 THEN 1 ELSE 0 END FROM dev))) AS v(check_name, n_violations)""").replace(
    "SELECT * FROM (VALUES", "SELECT check_name AS \"check\", CAST(n_violations AS BIGINT) AS n_violations, "
    "n_violations = 0 AS ok FROM (VALUES"))
def q_validate_folds(spark, sf):
    dev = _lines_folds(spark, sf)
    return CK.validate_folds(dev.select("row_id"), dev.select("row_id", "fold"), SET.n_folds)


@register("bounded_sample", sql=Q.with_ctes(LINES, f"""
SELECT fold, row_id, returned FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(row_id || '|{SET.seed + 10000}'), row_id) AS k FROM dev)
WHERE k <= {SET.max_explain}"""))
def q_bounded_sample(spark, sf):
    dev, _ = _lines_split(spark, sf)
    return S.bounded_sample(dev, ["fold"], SET.max_explain, SET.seed + 10000).select("fold", "row_id", "returned")


# =========================================================================== 2.6 training and scoring
from riskfold.operators import boost as BO  # noqa: E402
from riskfold.plans import experiments as EX  # noqa: E402

_MEMO: dict = {}


def _mats(spark, sf):
    """Matrices are checkpointed; reuse them across queries of one session."""
    key = ("mats", spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        _MEMO[key] = EX.matrices(spark, sf, ACCOUNTS, SET)
    return _MEMO[key]


def _model(spark, sf, model_key):
    """The three model families are fitted together (shared histogram jobs)
    the first time any of them is asked for."""
    key = ("models", spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        _MEMO[key] = EX.fit_models(_mats(spark, sf))
    return _MEMO[key][model_key]


@register("boost_stumps")
def q_boost_stumps(spark, sf):
    kind, cuts, model = _model(spark, sf, "adaboost")
    return BO.model_table(spark, model, kind)


@register("boost_depthwise")
def q_boost_depthwise(spark, sf):
    kind, cuts, model = _model(spark, sf, "xgboost")
    return BO.model_table(spark, model, kind)


@register("boost_leafwise")
def q_boost_leafwise(spark, sf):
    kind, cuts, model = _model(spark, sf, "lightgbm")
    return BO.model_table(spark, model, kind)


@register("score_rows")
def q_score_rows(spark, sf):
    m = _mats(spark, sf)
    kind, cuts, model = _model(spark, sf, "adaboost")
    return BO.score_rows(m.apply, cuts, model, kind, m.blocks)


def _scores_of(spark, sf, groups: str | None = None):
    return EX.cv_scores(spark, _mats(spark, sf), ACCOUNTS, fitted=_all_models(spark, sf), groups=groups)


def _held_scores(spark, sf, groups: str | None = None):
    """Scores without row ids, scored once for all the metrics that read them."""
    return materialize(_scores_of(spark, sf, groups).drop("row_id"))


@register("cv_scores")
def q_cv_scores(spark, sf):
    return _scores_of(spark, sf, "g >= 0")


@register("holdout_scores")
def q_holdout_scores(spark, sf):
    return _scores_of(spark, sf, "g = -1")


@register("cv_fold_metrics")
def q_cv_fold_metrics(spark, sf):
    rows = M.fold_metrics(_held_scores(spark, sf, "g >= 0"), SET.threshold)
    return EX.with_fit_seconds(rows.withColumn("fold", F.col("fold") + 1), _all_models(spark, sf))


@register("nested_cv")
def q_nested_cv(spark, sf):
    """Configuration chosen on inner folds of each outer fold's training rows,
    and its metrics on the outer fold's rows."""
    from riskfold.plans.nested import nested_cv
    return nested_cv(spark, sf, ACCOUNTS, SET)


def _all_models(spark, sf):
    _model(spark, sf, "adaboost")
    return _MEMO[("models", spark.sparkContext.applicationId, sf)]


# =========================================================================== 2.8 attributions
from riskfold.operators import attrib as AT  # noqa: E402


def _explained(spark, sf):
    """All validation rows of each fold (the study's bounded sample of them is
    the ``bounded_sample`` operator), and a background of at most
    max_background training rows per fold."""
    key = ("explain", spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        m = _mats(spark, sf)
        rows = m.apply.where("g >= 0")
        bg_rows = S.bounded_sample(m.train.where("g >= 0"), ["g"], SET.max_background, SET.seed + 10000) \
            .select("g", "x").collect()                                     # <= 50 x p per fold
        import numpy as np
        bg: dict = {}
        for r in bg_rows:
            bg.setdefault(int(r["g"]), []).append(r["x"])
        _MEMO[key] = (rows, {g: np.asarray(v, dtype=float) for g, v in bg.items()})
    return _MEMO[key]


def _names(spark, sf):
    m = _mats(spark, sf)
    return spark.createDataFrame(list(enumerate(m.features)), "j int, feature string")


def _kept(spark, sf):
    """(g, j): features that each fold's selector kept."""
    return spark.createDataFrame([(g, j) for g, at in _mats(spark, sf).kept.items() for j in at], "g int, j int")


def _phi(spark, sf, model_key, interventional=False, values=None):
    m = _mats(spark, sf)
    rows, bg = _explained(spark, sf)
    kind, cuts, model = _model(spark, sf, model_key)
    model = {g: v for g, v in model.items() if g >= 0}
    if kind == "stumps":
        return AT.permutation_attributions(rows, cuts, model, m.n_features, bg, SET.seed, values=values)
    return AT.tree_attributions(rows, cuts, model, m.n_features, background=bg if interventional else None, values=values)


@register("tree_attributions")
def q_tree_attributions(spark, sf):
    return _phi(spark, sf, "xgboost")


@register("permutation_attributions")
def q_permutation_attributions(spark, sf):
    return _phi(spark, sf, "adaboost")


@register("interventional_attributions")
def q_interventional_attributions(spark, sf):
    return _phi(spark, sf, "xgboost", interventional=True)


def _additive(phi: DataFrame, output: DataFrame, column: str) -> DataFrame:
    """(fold, n_rows, n_additive): rows whose attributions and base add up to
    the model's output."""
    total = phi.groupBy("g", "row_id").agg((F.sum("phi") + F.first("base")).alias("total"))
    both = output.select("g", "row_id", F.col(column).alias("out")).where("g >= 0").join(total, ["g", "row_id"], "left")
    good = F.coalesce((F.abs(F.col("total") - F.col("out")) < 1e-6).cast("long"), F.lit(0))
    return both.groupBy(F.col("g").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(good).alias("n_additive"))


_ADDITIVE_SQL = Q.with_ctes(ACCOUNTS, "SELECT fold, count(*) AS n_rows, count(*) AS n_additive FROM dev GROUP BY fold")


def _scored(spark, sf, key):
    kind, cuts, model = _model(spark, sf, key)
    m = _mats(spark, sf)
    return BO.score_rows(m.apply, cuts, model, kind, m.blocks)


@register("tree_additivity", sql=_ADDITIVE_SQL)
def q_tree_additivity(spark, sf):
    return _additive(_phi(spark, sf, "xgboost"), _scored(spark, sf, "xgboost"), "margin")


@register("interventional_additivity", sql=_ADDITIVE_SQL)
def q_interventional_additivity(spark, sf):
    return _additive(_phi(spark, sf, "lightgbm", interventional=True), _scored(spark, sf, "lightgbm"), "margin")


@register("permutation_additivity", sql=_ADDITIVE_SQL)
def q_permutation_additivity(spark, sf):
    return _additive(_phi(spark, sf, "adaboost"), _scored(spark, sf, "adaboost"), "score")


def model_importance(spark, sf) -> DataFrame:
    """Importance frame of the three models (tree attributions for the tree
    models, permutation attributions for AdaBoost), one fold = one group;
    settled (models x folds x features rows), since its readers read it often."""
    memo = ("importance", spark.sparkContext.applicationId, sf)
    if memo in _MEMO:
        return _MEMO[memo]
    out = None
    for key in ("adaboost", "xgboost", "lightgbm"):
        imp = AT.importance(_phi(spark, sf, key), _names(spark, sf), _kept(spark, sf)).select(
            F.lit(ACCOUNTS.key).alias("dataset_key"), F.lit(ACCOUNTS.name).alias("dataset_name"),
            F.lit(key).alias("model_key"), F.lit(EX.MODEL_SPECS[key]["display"]).alias("model_name"),
            F.col("g").alias("fold"), "feature", "mean_abs_shap", "rank")
        out = imp if out is None else out.unionByName(imp)
    _MEMO[memo] = settle(out)
    return _MEMO[memo]


@register("model_feature_importance")
def q_model_feature_importance(spark, sf):
    return model_importance(spark, sf)


@register("model_stability_summary")
def q_model_stability_summary(spark, sf):
    return ST.stability_summary(ST.pairwise_stability(model_importance(spark, sf), SET.top_k))


@register("model_attribution_log")
def q_model_attribution_log(spark, sf):
    rows, bg = _explained(spark, sf)
    m = _mats(spark, sf)
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n_explained"))
    explainer = {"adaboost": "permutation", "xgboost": "tree", "lightgbm": "tree"}
    out = None
    for key, ex in explainer.items():
        part = n.select(F.lit(key).alias("model_key"), F.col("g").alias("fold"), F.lit(ex).alias("explainer"),
                        "n_explained",
                        F.lit(0).alias("n_background") if ex == "tree" else
                        F.element_at(F.create_map(*[x for g, v in bg.items() for x in (F.lit(g), F.lit(len(v)))]),
                                     F.col("g")).alias("n_background"),
                        F.lit(m.n_features).alias("n_features"))
        out = part if out is None else out.unionByName(part)
    return out


@register("attribution_long")
def q_attribution_long(spark, sf):
    """Stacked (model, fold, row, feature, value, attribution) for the top-k
    features of each model's consensus ranking (the data behind beeswarm,
    bar and violin charts)."""
    imp = model_importance(spark, sf)
    top = ST.consensus_ranking(imp, SET.top_k).where(F.col("consensus_rank") <= SET.top_k) \
        .select("model_key", "feature")
    place = {name: j for j, name in enumerate(_mats(spark, sf).features)}
    names, chosen, out = _names(spark, sf), {}, None
    for r in top.collect():                                              # models x top_k
        chosen.setdefault(r["model_key"], []).append(place[r["feature"]])
    for key in ("adaboost", "xgboost", "lightgbm"):
        # the values travel with the attributions: no join of rows
        ph = _phi(spark, sf, key, values=chosen.get(key, [])).withColumn("model_key", F.lit(key))
        out = ph if out is None else out.unionByName(ph)
    return out.join(F.broadcast(names), "j").select(
        "model_key", F.col("g").alias("fold"), "row_id", "feature", "value", F.col("phi").alias("attribution"))


@register("per_fold_rankings")
def q_per_fold_rankings(spark, sf):
    """Per-fold rankings from interventional attributions with the fold's own
    training rows as background (development rows only)."""
    imp = AT.importance(_phi(spark, sf, "xgboost", interventional=True), _names(spark, sf), _kept(spark, sf)).select(
        F.lit(ACCOUNTS.key).alias("dataset_key"), F.lit(ACCOUNTS.name).alias("dataset_name"),
        F.lit("xgboost").alias("model_key"), F.lit("XGBoost").alias("model_name"),
        F.col("g").alias("fold"), "feature", "mean_abs_shap", "rank")
    return ST.ranking_lists(imp)


@register("sink_processed", sql=Q.with_ctes(LINES, _PROCESSED_SQL, _PROCESSED_CTES, full_fit=True))
def q_sink_processed(spark, sf):
    """Write the processed splits and the fold manifest into the shared
    checkpoint folder, read both back (round trip) and show them in long form."""
    from riskfold.plans.process import process, read_back, write_outputs
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-out-{uuid.uuid4().hex}"
    done = process(spark, sf, LINES, SET)
    write_outputs(done, folder)
    return read_back(spark, done, folder)


from riskfold import catalog_reports  # noqa: E402, F401  (registers its queries)
