"""Raw cohort -> cleaned rows with ``split`` and ``fold``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.config import Cohort, Settings
from riskfold.operators.clean import clean_cohort
from riskfold.operators.split import hash_part, split_and_folds_of, stratified_folds, stratified_split
from riskfold.session import discard, has_rows, shared_folder, write_rows
from riskfold.sources.tables import COHORTS, raw_cohort


def clean_rows(spark: SparkSession, sf_dir: str, cohort: Cohort | str) -> DataFrame:
    cohort = COHORTS[cohort] if isinstance(cohort, str) else cohort
    return clean_cohort(raw_cohort(spark, sf_dir, cohort.key), cohort)


def clean_and_split(spark: SparkSession, sf_dir: str, cohort: Cohort | str,
                    settings: Settings = Settings()) -> DataFrame:
    """Raw -> clean -> stratified split (``split`` column)."""
    cohort = COHORTS[cohort] if isinstance(cohort, str) else cohort
    clean = clean_rows(spark, sf_dir, cohort)
    return stratified_split(clean, cohort.target, settings.seed, settings.test_size)


#: Source files of up to so many bytes are joined and ranked in one part; larger ones in at most so many parts.
PART_BYTES, MOST_PARTS = 256 << 20, 4


def part_count(raw: DataFrame, most: int = MOST_PARTS) -> int:
    """Parts by the size of the files that ``raw`` reads."""
    leaves = raw._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return max(1, min(most, -(-size // PART_BYTES)))


def assign(spark: SparkSession, sf_dir: str, cohort: Cohort | str,
           settings: Settings = Settings(), columns: list[str] | None = None, parts: int | None = None, out: str | None = None) -> DataFrame:
    """All cleaned rows with ``split`` and, for train rows, ``fold``, held in a
    folder that driver and executors share (``out``).  ``columns``: what else is wanted
    besides row id and target; None: all.  Large sources are joined by parts of
    the key and ranked by runs of the seeded order, so that exchanges never
    hold more than a part of the rows on disk; all rows are in the result."""
    cohort = COHORTS[cohort] if isinstance(cohort, str) else cohort
    raw = raw_cohort(spark, sf_dir, cohort.key)
    n = (parts or part_count(raw)) if cohort.key_columns else 1
    keyed = bool(cohort.key_columns)   # such a row id is the hex text of 16 bytes
    text = F.lower(F.hex("row_id"))

    def opened(df: DataFrame) -> DataFrame:
        return df.withColumn("row_id", text) if keyed else df

    # the cleaned cohort feeds the quota job and the rank: read and join the sources once
    folder, out, schema = shared_folder(spark, "clean"), out or shared_folder(spark, "assigned"), None
    for i in range(n):
        own = raw if n == 1 else raw.where(F.pmod(F.xxhash64(cohort.key_columns[0]), F.lit(n)) == i)
        clean = clean_cohort(own, cohort)
        if columns is not None:
            clean = clean.select("row_id", cohort.target, *columns)
        dealt = clean.withColumn("_part", hash_part(settings.seed, n)) if n > 1 else clean.withColumn("_part", F.lit(0))
        if keyed:
            dealt = dealt.withColumn("row_id", F.unhex("row_id"))
        write_rows(dealt, folder, ["_part"])
        schema = dealt.drop("_part").schema
    at = [f"{folder}/_part={i}" for i in range(n)]
    held = [opened(spark.read.schema(schema).parquet(p)) for p in at if has_rows(spark, p)]
    at = [p for p in at if has_rows(spark, p)]
    if not held:
        raise ValueError("cannot split an empty frame")
    if settings.shuffle:
        done = split_and_folds_of(held, cohort.target, settings.seed, settings.test_size, settings.n_folds)
    else:
        whole = reduce(DataFrame.unionByName, held)
        split = stratified_split(whole, cohort.target, settings.seed, settings.test_size)
        train = stratified_folds(split.where(F.col("split") == "train"), cohort.target,
                                 settings.n_folds, settings.seed, settings.shuffle)
        done = [train.unionByName(split.where(F.col("split") == "test").withColumn("fold", F.lit(None).cast("int")))]
    for i, ranked in enumerate(done):
        write_rows(ranked.withColumn("row_id", F.unhex("row_id")) if keyed else ranked, out)
        if settings.shuffle:
            discard(spark, at[i])   # ranked and written: nothing reads it again
    kinds = {f.name: f for f in schema.fields}
    names = [*kinds, "split", "fold"]
    return opened(spark.read.schema(T.StructType([kinds.get(c) or T.StructField(c, T.StringType() if c == "split" else T.IntegerType()) for c in names])).parquet(out))


def dev_and_test(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (assigned.where(F.col("split") == "train"), assigned.where(F.col("split") == "test"))
