"""Best-fit packing with several permitted sequence lengths.

A document is its blank-separated words and one end mark, or as many units as
``length`` says (token counts, say); one that exceeds the largest
capacity is cut to pieces of that capacity and a rest, so nothing is lost.
Packing works on the counts of each piece length (at most the largest capacity
rows, whatever the corpus): longest first, each length goes into the open bins
of least remaining room that take it; where none does, a bin is opened of the
capacity with the least cost per token, judged for all permitted capacities
jointly by what the lengths still waiting would fill.  Only as many bins are
opened at once as those fillers last for; the fillers are then taken as spoken
for and the capacities judged again.  At the end each bin
shrinks to the smallest permitted capacity that holds its contents.

Bins that are filled alike stay one interval of bin numbers, so the plan has
at most 6 x lengths x sqrt(2 x capacity) rows, whatever the corpus.  A piece
finds its place by its rank among the pieces of its length; ranks come from
hash buckets of about ``BUCKET`` rows, so a length that very many share is
spread over tasks.

Null text has the end mark only, like the empty text.  Ranks order by id (null
first), then row: repeated rows get places of their own.  An empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.common import documents, stash, words
from riskfold.session import ship_package

CAPACITIES, BUCKET = (512, 1024, 2048, 4096), 1000


def cost(capacity: int) -> float:
    """Cost of a sequence: linear work and attention."""
    return capacity * (1 + capacity / 8192)


@dataclass
class Plan:
    """Places: pieces [lo, hi) of a length go ``per_bin`` a bin from bin
    ``first`` on, at ``offset`` in the bin.  Bins: intervals with their final
    capacity."""

    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, lo, hi, first, per_bin, offset
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)  # first, count, capacity, used


class _Waiting:
    """Lengths that still wait, and what a bin's room would take of them."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts, self.lengths = dict(counts), sorted(counts)

    def drop(self, length: int) -> None:
        at = bisect_left(self.lengths, length)
        if at < len(self.lengths) and self.lengths[at] == length:
            del self.lengths[at]

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, pieces) that a bin's room would take."""
        taken, at = [], len(self.lengths)
        while room and at:
            at = bisect_left(self.lengths, room + 1, 0, at) - 1
            if at < 0:
                break
            length = self.lengths[at]
            n = min(room // length, self.counts[length])
            taken.append((length, n))
            room -= n * length
        return taken

    def reserve(self, taken: list[tuple[int, int]], bins: int) -> None:
        """The fillers of so many bins don't wait any longer."""
        for length, n in taken:
            self.counts[length] -= n * bins
            if not self.counts[length]:
                self.drop(length)


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES) -> Plan:
    """Variable-capacity best fit decreasing on length counts."""
    sizes = sorted(set(capacities))
    out, waiting = Plan(), _Waiting({k: n for k, n in counts.items() if n})
    rooms: list[int] = []  # remaining rooms with open bins, ascending
    open_: dict[int, deque] = defaultdict(deque)  # room -> intervals (first, count, capacity)
    bins = 0

    def put(room: int, first: int, count: int, capacity: int) -> None:
        if count:
            if room not in open_ or not open_[room]:
                insort(rooms, room)
            open_[room].append((first, count, capacity))

    def place(length: int, lo: int, n: int, room: int, first: int, count: int, capacity: int) -> int:
        """Fill the interval with up to n pieces; returns how many went in."""
        per = room // length
        whole = min(count, n // per)
        if whole:
            out.places.append((length, lo, lo + whole * per, first, per, capacity - room))
            put(room - per * length, first, whole, capacity)
        part = n - whole * per if whole < count else 0
        if part:  # the pieces run out within one bin
            out.places.append((length, lo + whole * per, lo + n, first + whole, part, capacity - room))
            put(room - part * length, first + whole, 1, capacity)
        put(room, first + whole + bool(part), count - whole - bool(part), capacity)
        return whole * per + part

    for length in sorted(waiting.counts, reverse=True):
        n, lo = counts[length], 0
        waiting.drop(length)
        while lo < n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                interval = open_[room].popleft()
                if not open_[room]:
                    del open_[room], rooms[at]
                lo += place(length, lo, n - lo, room, *interval)
                continue
            fits = [c for c in sizes if c >= length]

            def per_token(c: int) -> float:
                k = min(c // length, n - lo)
                used = k * length + sum(x * m for x, m in waiting.fill(c - k * length))
                return cost(next(s for s in sizes if s >= used)) / used

            capacity = min(fits, key=lambda c: (per_token(c), c))
            per = min(capacity // length, n - lo)
            taken = waiting.fill(capacity - per * length)
            count = min([(n - lo) // per, *[waiting.counts[x] // m for x, m in taken]])
            waiting.reserve(taken, count)
            first, bins = bins, bins + count
            lo += place(length, lo, n - lo, capacity, first, count, capacity)
    for room in rooms:
        for first, count, capacity in open_[room]:
            used = capacity - room
            out.bins.append((first, count, next(s for s in sizes if s >= used), used))
    out.bins.sort()
    return out


def pieces(docs: DataFrame, largest: int, text: str = "text", doc_id: str = "doc_id", length: Column | None = None) -> DataFrame:
    """(doc_id, _k, piece, start, length): ``length`` units (words and the end
    mark if not given; at least 1), cut at ``largest``."""
    n = F.size(words(F.col(text))).cast("long") + 1 if length is None else F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("_k"), n.alias("n"))
    each = own.select("doc_id", "_k", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    start = F.col("piece") * largest
    return each.select("doc_id", "_k", F.col("piece").cast("int").alias("piece"), start.alias("start"),
                       F.least(F.col("n") - start, F.lit(largest)).cast("int").alias("length"))


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` plus ``rank`` within the length, from 0."""
    spark = rows.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // BUCKET)) for k, n in counts.items()], "length int, buckets long")  # a row a length
    dealt = rows.join(F.broadcast(buckets), "length").withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "_k"), "buckets")).drop("buckets")
    sizes = dealt.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("_b")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "_k"))
    return dealt.withColumn("own", own).join(before, ["length", "_b"]).withColumn("rank", F.col("own") - 1 + F.col("before")).drop("own", "before", "_b")


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, text: str = "text", doc_id: str = "doc_id",
         length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, capacity, offset) for every piece;
    ``length`` is each document's units, end mark included (default: words + 1)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = stash(pieces(docs, max(capacities), text, doc_id, length), "pack-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most the largest capacity
    made = plan(counts, capacities)
    places = np.array(sorted(made.places), np.int64).reshape(-1, 6)
    bins = np.array(made.bins, np.int64).reshape(-1, 4)
    packed = spark.sparkContext.broadcast((places, bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, bins = packed.value
        keys = places[:, 0] << 44 | places[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length.astype(np.int64) << 44 | rank, "right") - 1
            _, lo, _, first, per, offset = places[at].T
            nth = rank - lo
            bin_id = first + nth // per
            held = np.searchsorted(bins[:, 0], bin_id, "right") - 1
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bin_id), pa.array(bins[held, 2].astype(np.int32)), pa.array((offset + nth % per * length).astype(np.int32))],
                                             ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"])

    named = ranked(rows, counts).select(F.col("doc_id"), "piece", "start", "length", F.col("rank").cast("long").alias("rank"))
    kind = dict(named.dtypes)["doc_id"]
    return named.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, bin_id long, capacity int, offset int")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
