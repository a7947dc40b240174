"""Stable row identity and hash ordering.

Spark has no row position, so every row gets a ``row_id`` derived from its
content: the md5 of a declared unique key, or, without a key, the md5 of all
columns plus a copy number among identical rows.  Ordering by
``md5(row_id || '|' || seed)`` is a seeded shuffle that DuckDB reproduces bit
for bit (same md5, same hex text), and that survives task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: text written for NULL inside hashed keys.
NULL_MARK = "\\N"
# Copies of one row are numbered in chunks of this many per task.
COPY_CHUNK = 1 << 20


def key_text(cols: list[str] | tuple[str, ...]) -> Column:
    """'|'-joined text of the columns, NULL written as ``\\N``.  Only integer
    and string columns give the same text in Spark and DuckDB."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in cols])


def key_hash(cols: list[str] | tuple[str, ...]) -> Column:
    return F.md5(key_text(cols))


def seeded_order(row_id: str | Column, seed: int) -> Column:
    """Uniform 32-hex-char sort key; identical in DuckDB as
    ``md5(row_id || '|' || seed)``."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("|", rid, F.lit(str(seed))))


def with_key_row_id(df: DataFrame, key_cols: tuple[str, ...], drop_key: bool = True) -> DataFrame:
    """row_id = md5 of a declared unique key; a narrow projection, no shuffle."""
    out = df.withColumn("row_id", key_hash(key_cols))
    if drop_key:
        out = out.drop(*key_cols)
    return out.select("row_id", *[c for c in out.columns if c != "row_id"])


def with_content_row_id(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """row_id = md5(all columns) + '#' + copy number among identical rows.

    Identical rows are interchangeable, so numbering them 0..n-1 in any order
    gives the same multiset of (content, row_id).  Copies are counted with a
    hash aggregate (map-side combine, so a group of copies holding a third of
    the table costs one row per task), then re-emitted by a two-level explode:
    chunks first, spread over tasks, then the copies inside each chunk.  No
    window ever holds a whole group of copies.
    """
    cols = list(cols or df.columns)
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    chunked = (
        counted.withColumn("_h", key_hash(cols))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1,
                                                      F.lit(COPY_CHUNK).cast("long"))))
        .repartition("_h", "_chunk")
    )
    copies = chunked.withColumn(
        "_copy",
        F.explode(F.sequence(F.col("_chunk"),
                             F.least(F.col("_chunk") + COPY_CHUNK, F.col("_copies")) - 1)),
    )
    out = copies.withColumn("row_id", F.concat(F.col("_h"), F.lit("#"), F.col("_copy").cast("string")))
    return out.select("row_id", *cols)


def with_unique_content_row_id(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """row_id = md5(all columns) + '#0' for input that is already duplicate
    free (after ``dedupe_rows``); narrow, no shuffle."""
    cols = list(cols or df.columns)
    return df.select(F.concat(key_hash(cols), F.lit("#0")).alias("row_id"), *cols)
