"""SimHash near-duplicates with multi-index hashing.

A fingerprint has a bit set where over half of the text's word shingles
(repeats included) have it in their XXH64.  Fingerprints link at ``bits`` or
fewer differing bits.  The 64 bits are cut to ``SEGMENTS`` segments; by the
pigeonhole rule two linked fingerprints differ in at most bits // SEGMENTS
places of some segment.  Each distinct fingerprint is entered in one table per
segment, probes it with the small Hamming ball around its own value, and what
it finds is verified on all 64 bits inside the join.

Copies are one fingerprint and never meet as pairs; links are between
different fingerprints only (each has at most 43,744 others within 3 bits).
A segment value that many share is an ordinary skewed join key.

A text without words has fingerprint zero and links like any other; fewer
words than a shingle form one shingle; null text is the empty text.  A null id
never becomes a component id unless its component has no other; of each
component the row with the smallest id, then the first read, is the keeper, so
repeated rows leave one.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from riskfold.llm.common import add_columns, documents, exchanged, stash, without
from riskfold.llm.components import connected_components

SHINGLE, BITS, SEGMENTS = 3, 3, 2
#: Rows to drop are broadcast up to this count, joined by exchange beyond it.
BROADCAST_ROWS = 500_000
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of the whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [one(joined, 42)]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *[e + 1 for e in ends]]
        hashes = [one(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:])]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(raw), _BLOCK):
        votes += np.unpackbits(raw[lo:lo + _BLOCK], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus ``fp``, the fingerprint as a signed long."""

    def make():
        def work(texts: list) -> list:
            prints = [fingerprint(t, shingle) for t in texts]
            return [[p - (1 << 64) if p >> 63 else p for p in prints]]
        return work

    return add_columns(docs, [text], [StructField("fp", LongType())], make)


def balls(width: int, radius: int) -> list[int]:
    """Masks of the Hamming ball of a segment."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]


def links(prints: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """(u, v) for all pairs of the distinct fingerprints (fp) that differ in 1
    to ``bits`` bits, u < v."""
    width = -(-64 // segments)
    keys, probes = [], []
    for s in range(segments):
        size = min(width, 64 - s * width)
        value = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))
        place = F.lit(s) if size == 64 else F.lit(s << size)
        keys.append(value + place)
        probes += [value.bitwiseXOR(F.lit(m)) + place for m in balls(size, bits // segments)]
    table = prints.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("u"))
    probe = prints.select(F.explode(F.array(*probes)).alias("key"), F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    return table.join(exchanged(probe), "key").where(near & (F.col("u") < F.col("v"))).select("u", "v")


def classes(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id, keeper) for each distinct fingerprint of ``rows``
    (doc_id, _k, fp); keeper is the _k of the row that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k")).alias("first")
    each = stash(rows.groupBy("fp").agg(first), "simhash-prints")
    roots = connected_components(links(each.select("fp"), bits), "simhash-links")
    rooted = each.join(exchanged(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(exchanged(best), "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best._k").alias("keeper"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, _k, fp, component_id, keeper) per row of ``docs``; ``_k`` is a
    row number."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_k"))
    rows = stash(fingerprints(own, "_t", shingle).drop("_t"), "simhash-rows")
    return rows.join(exchanged(classes(rows, bits)), "fp").select("doc_id", "_k", "fp", "component_id", "keeper")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, one of each component, same columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"),
                      F.monotonically_increasing_id().alias("_k"))
    held = stash(fingerprints(own, "_t", shingle).drop("_t"), "simhash-docs")
    rows = held.select("doc_id", "_k", "fp")
    drop = stash(rows.join(exchanged(classes(rows, bits)), "fp").where("_k <> keeper").select("_k"), "simhash-drop")
    gone = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else exchanged(drop)
    return held.join(gone, "_k", "left_anti").select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(without(documents(spark, sf_dir), ["_k", "fp"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
