"""Corpus pipeline: toxicity, language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's
docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm import langid, packing, secrets, simhash, toxicity
from riskfold.llm.common import held_out, shared_folder
from riskfold.session import discard


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the operators' columns can't clash with the table's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    model = toxicity.train(toxicity.learning_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(_rows(docs), model).where("predicted = 0").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no learned language is found go: those without a
    letter, and those whose words fit none of the languages that label them
    (``lang_evidence``).  A text of several languages stays."""
    model = langid.train(docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()))
    return langid.identify(_rows(docs), model, spans=False).where((F.col("lang_pred") != "und") & (F.col("lang_evidence") >= langid.LEAST_EVIDENCE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in out.dtypes])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: The stages' models, fingerprints and packing can't be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote goes when its successor is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        folder = shared_folder(spark, f"stage-{name}")
        made.write.option("compression", "zstd").parquet(folder)
        docs = spark.read.schema(made.schema).parquet(folder)
        if before is not None:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
