"""Cleaning: empty columns, roles, duplicates, placeholder zeros, target,
feature-name sanitising, stable row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.config import Cohort
from riskfold.functions.rowid import (with_content_row_id, with_key_row_id,
                                      with_unique_content_row_id)


def column_profile(df: DataFrame) -> DataFrame:
    """(pos, column, non_null, rows): one aggregate job, unpivoted."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"{i}, '{c}', c{i}" for i, c in enumerate(df.columns))
    return counts.selectExpr("__rows as rows",
                             f"stack({len(df.columns)}, {stack}) as (pos, column, non_null)") \
                 .select("pos", "column", "non_null", "rows")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns with no non-null value (the list of survivors is a schema
    decision, so it is collected: one row per column)."""
    keep = [r["column"] for r in column_profile(df).where("non_null > 0").orderBy("pos").collect()]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def require_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to predict among {df.columns}")


def column_roles(columns: list[str], numeric: tuple[str, ...] | list[str], target: str) -> tuple[list[str], list[str]]:
    """Explicit numeric allow-list; every other non-target column is
    categorical; column order preserved."""
    feats = [c for c in columns if c != target]
    return [c for c in feats if c in numeric], [c for c in feats if c not in numeric]


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate removal over all columns (NULLs equal).  A hash
    aggregate: copies collapse map-side before the shuffle."""
    return df.dropDuplicates()


def zero_as_missing(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*[(F.when(F.col(c) == 0, F.lit(None).cast(df.schema[c].dataType))
                        .otherwise(F.col(c)).alias(c)) if c in columns else F.col(c)
                       for c in df.columns])


def clean_target(df: DataFrame, target: str) -> DataFrame:
    """Drop rows with a NULL target; text targets map Yes->1, No->0 and any
    other label fails the job; result is a non-null int."""
    kept = df.where(F.col(target).isNotNull())
    if isinstance(df.schema[target].dataType, T.StringType):
        code = (F.when(F.col(target) == "Yes", F.lit(1))
                 .when(F.col(target) == "No", F.lit(0))
                 .otherwise(F.raise_error(F.concat(F.lit("unexpected target label: "), F.col(target)))))
    else:
        code = F.col(target)
    return kept.withColumn(target, code.cast("int"))


def sanitize_name_table(names: DataFrame, name_col: str = "name", pos_col: str = "pos") -> DataFrame:
    """Runs of characters outside [A-Za-z0-9_] become one '_'; the 2nd, 3rd
    equal name get '_1', '_2' (in column order).  A name that still collides
    after that fails the job."""
    safe = F.regexp_replace(F.col(name_col), "[^A-Za-z0-9_]+", "_")
    w = Window.partitionBy("_safe").orderBy(pos_col)
    out = (names.withColumn("_safe", safe)
                .withColumn("_dup", F.row_number().over(w) - 1)
                .withColumn("safe_name", F.when(F.col("_dup") == 0, F.col("_safe"))
                            .otherwise(F.concat(F.col("_safe"), F.lit("_"), F.col("_dup").cast("string")))))
    w2 = Window.partitionBy("safe_name")
    out = out.withColumn("safe_name", F.when(F.count(F.lit(1)).over(w2) > 1,
                                             F.raise_error(F.concat(F.lit("feature name collision: "),
                                                                    F.col("safe_name"))).cast("string"))
                         .otherwise(F.col("safe_name")))
    return out.drop("_safe", "_dup")


def sanitize_names(names: list[str]) -> list[str]:
    """Driver-side twin for schema renames (names are schema, not data)."""
    import re
    seen: dict[str, int] = {}
    out = []
    for n in names:
        s = re.sub(r"[^A-Za-z0-9_]+", "_", n)
        k = seen.get(s, 0)
        out.append(s if k == 0 else f"{s}_{k}")
        seen[s] = k + 1
    if len(set(out)) != len(out):
        raise ValueError(f"feature name collision after sanitising: {out}")
    return out


def with_row_id(df: DataFrame, cohort: Cohort) -> DataFrame:
    """Stable row ids: md5 of the declared key, else content hash (+ copy
    number when duplicates may remain)."""
    if cohort.key_columns:
        return with_key_row_id(df, cohort.key_columns)
    if cohort.dedupe:
        return with_unique_content_row_id(df)
    return with_content_row_id(df)


def clean_cohort(raw: DataFrame, cohort: Cohort) -> DataFrame:
    """Raw -> (dedupe) -> row ids -> zero recode -> target cleaning.
    Order as in the study: duplicates are removed before zero recoding and
    target cleaning."""
    df = raw
    if cohort.dedupe:
        df = dedupe_rows(df)
    df = with_row_id(df, cohort)
    if cohort.zero_as_missing:
        df = zero_as_missing(df, cohort.zero_as_missing)
    return clean_target(df, cohort.target)
