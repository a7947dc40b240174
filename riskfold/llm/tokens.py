"""Binary token output: canonical length-limited Huffman code of the ids.

The ids of all documents (end id appended) are counted over the whole corpus;
package-merge gives code lengths of at most ``LIMIT`` bits, canonical codes
follow from the lengths alone.  Documents in ascending id order go to shards.

Format of a shard (little-endian): magic ``HUF2``; uint32 documents, ids,
blocks, ids per block, documents without an id (they come first); int64 ids of
the documents and uint32 lengths in ids; uint64 bit offset of every block (the checkpoints); the
code bits, most significant first, padded with 8 zero bytes.  Shards are rows
of a Parquet table, so that Spark's commit protocol covers lost tasks and any
store will do; the code lengths are a table beside them.  Blocks decode
independently: a shard's blocks advance side by side, one table look-up per
id.

Null text is the empty text: only the end id.  Null ids come first; rows with
equal ids follow each other in the order read (equal rows are alike); an empty
table gives an empty result.  Extra columns, whatever their names, are not
read.  A very long text is one row of the exchange, two bytes an id; pieces of
over ``KEPT_CHARS`` are encoded each time and not held.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.bpe import byte_letters
from riskfold.llm.common import documents, shared_folder, slices, stash
from riskfold.session import ship_package

MAGIC, HEADER = b"HUF2", struct.Struct("<4sIIIII")
LIMIT, BLOCK, SHARD_IDS, PART_IDS = 18, 512, 1 << 20, 4_000_000
#: Pieces that a worker holds, and the longest that it holds.
CACHED, KEPT_CHARS = 1_300_000, 48
SHARDS = "part int, place long, first_id long, n_ids long, shard binary"

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same cut for texts up to U+024F without rare white space and numbers, where letters are these ranges.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_RARE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
_RARE_BYTES = [bytes([b]) for b in (0x1c, 0x1d, 0x1e, 0x1f, 0xb2, 0xb3, 0xb9, 0xbc, 0xbd, 0xbe)]


def _is_plain(text: str) -> bool:
    try:
        raw = text.encode("latin-1")  # single searches for bytes are far faster than the pattern
    except UnicodeEncodeError:
        return not _RARE.search(text)
    return not any(b in raw for b in _RARE_BYTES)


class Pieces(dict):
    """Packed ids of pieces; a piece not met lately goes through the library."""

    def __init__(self, model, code: str) -> None:
        super().__init__()
        self.model, self.letters = model, dict(enumerate(byte_letters()))
        self.packers = [struct.Struct(f"<{n}{code}").pack for n in range(KEPT_CHARS + 1)]
        self.code = np.dtype("<u2" if code == "H" else "<u4")

    def __missing__(self, piece: str) -> bytes:
        # the piece as byte letters
        found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        if len(found) > KEPT_CHARS:
            return np.array(found, self.code).tobytes()
        made = self.packers[len(found)](*found)
        if len(piece) <= KEPT_CHARS:
            self[piece] = made
        return made


def cut(text: str) -> list[str]:
    """Pieces of a text without special tokens."""
    return (_PLAIN if _is_plain(text) else _SPLIT).findall(text)


class Encoder:
    """Ids of texts with the tokenizers library, which sees each piece once
    while it is among those met lately."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.top = max([self.lib.get_vocab_size(), *special.values()])
        self.code, self.width = ("H", "<u2") if self.top < 1 << 16 else ("I", "<u4")
        self.special = {s: struct.pack(f"<{self.code}", i) for s, i in special.items()}
        self.at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = Pieces(self.lib.model, self.code)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids in little-endian ``width``, with the end id."""
        known, last, out = self.pieces, struct.pack(f"<{self.code}", end), []
        if len(known) > CACHED:
            known.clear()
        for t in texts:
            parts = self.at.split(t) if t and self.at and "<|" in t else [t or ""]
            out.append(b"".join([self.special.get(p) or b"".join(map(known.__getitem__, cut(p))) for p in parts]) + last)
        return out


_LOADED: dict[str, Encoder] = {}


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits by
    package-merge; zero where the count is zero."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    flags, items = [], leaves
    for _ in range(limit):
        flags.append(None)
        kinds = np.concatenate([np.ones(len(leaves), bool), np.zeros(len(items) // 2 if flags[0] is not None else 0, bool)])
        both = np.concatenate([leaves, items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)]) if flags[0] is not None else leaves
        by = np.argsort(both, kind="stable")
        items, flags[-1] = both[by], kinds[by]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kinds in reversed(flags):
        n = int(kinds[:take].sum())
        depth[:n] += 1
        take = 2 * (min(take, len(kinds)) - n)
    out[order] = depth
    return out


@dataclass
class Code:
    """Canonical code from the lengths: codes by (length, id)."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        self.order = order[self.lengths[order] > 0]
        size = self.lengths[self.order].astype(np.int64)
        self.limit = int(size.max()) if len(size) else 1
        span = np.left_shift(1, self.limit - size)
        first = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(size) else size
        self.codes = np.zeros(len(self.lengths), np.int64)
        self.codes[self.order] = first >> (self.limit - size)
        self.both = self.codes << 8 | self.lengths  # one look-up when packing
        self.table = np.zeros(1 << self.limit, np.int64)  # id << 8 | length by the next bits
        if len(size):
            self.table[:int(span.sum())] = np.repeat(self.order << 8 | size, span)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the code bits."""
        both = self.both[ids]
        size = both & 255
        end = np.cumsum(size)
        start = end - size
        shifted = (both >> 8).astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
        word = start >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))  # codes that begin in the same word
        out, at = np.zeros(int(end[-1] >> 5) + 3, np.uint64), word[first]
        out[at] = np.add.reduceat(shifted >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return start[::BLOCK].astype("<u8"), out.astype(">u4").tobytes()

    def unpack(self, bits: bytes, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
        """The ``n`` ids: all blocks advance together, an id a step."""
        b = np.frombuffer(bits, np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        out = np.zeros((block, len(offsets)), np.int64)
        at, shift = offsets.astype(np.int64), 32 - self.limit
        full = len(offsets) if n % block == 0 else len(offsets) - 1
        for step in range(min(block, n)):
            if step == n - full * block:  # the last block is shorter
                at = at[:full]
            word = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(shift)
            found = self.table[word]
            out[step, :len(at)] = found >> 8
            at = at + (found & 255)
        return out.T.reshape(-1)[:n]


def write_shard(code: Code, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    offsets, bits = code.pack(ids)
    nameless = sum(i is None for i in doc_ids)  # the first ones, by the order of the documents
    head = HEADER.pack(MAGIC, len(sizes), len(ids), len(offsets), BLOCK, nameless)
    names = np.array([0 if i is None else i for i in doc_ids], "<i8")
    return b"".join([head, names.tobytes(), np.array(sizes, "<u4").tobytes(), offsets.tobytes(), bits, bytes(8)])


def read_shard(code: Code, shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids."""
    magic, docs, n, blocks, block, nameless = HEADER.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEADER.size
    names = np.frombuffer(shard, "<i8", docs, at)
    sizes = np.frombuffer(shard, "<u4", docs, at + 8 * docs)
    offsets = np.frombuffer(shard, "<u8", blocks, at + 12 * docs)
    ids = code.unpack(shard[at + 12 * docs + 8 * blocks:], offsets, n, block)
    return [None] * nameless + names[nameless:].tolist(), sizes, ids


def tokenize(docs: DataFrame, path: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (counted, doc_id, n, ids): documents with their number of ids and
    the ids as little-endian uint16 (uint32 if the vocabulary needs it); and,
    counted, each task's total of an id: the id in doc_id, its number in n."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        enc = _LOADED[path]
        size = struct.calcsize(f"<{enc.code}")
        total = np.zeros(max(enc.top, end) + 1, np.int64)
        gc.disable()  # lists of strings only: nothing here can form a cycle
        for b in slices(batches, 256):
            made = enc.encode(b.column(1).to_pylist(), end)
            total += np.bincount(np.frombuffer(b"".join(made), enc.width), minlength=len(total))
            yield rows(False, b.column(0), pa.array([len(m) // size for m in made], pa.int64()), pa.array(made, pa.binary()))
        gc.enable()
        at = np.flatnonzero(total)
        yield rows(True, pa.array(at, pa.int64()), pa.array(total[at]), pa.nulls(len(at), pa.binary()))

    def rows(counted: bool, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([counted] * len(columns[0]), pa.bool_()), *columns], ["counted", "doc_id", "n", "ids"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "counted boolean, doc_id long, n long, ids binary")


def count_ids(coded: DataFrame) -> DataFrame:
    """(id, n) over all rows, from the tasks' totals."""
    return coded.where("counted").groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("n"))


def write_shards(coded: DataFrame, code: Code, folder: str) -> None:
    """Shards of ``coded`` (doc_id, n, ids) in ascending id order below
    ``folder``: rows (part, place, first_id, n_ids, shard)."""
    spark = coded.sparkSession
    ship_package(spark)
    packed = spark.sparkContext.broadcast(code)
    coded = coded.where("not counted").select("doc_id", "n", "ids")
    total = coded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PART_IDS))
    ranged = coded.withColumn("_k", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "_k").sortWithinPartitions("doc_id", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, place, first = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            shard = write_shard(packed.value, names, [len(h) for h in held], np.concatenate(held).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([first], pa.int64()),
                                               pa.array([size], pa.int64()), pa.array([shard], pa.binary())], ["part", "place", "first_id", "n_ids", "shard"])

        part = 0
        for b in slices(batches, 1024):
            part = b.column(0)[0].as_py()
            for name, n, raw in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                names.append(name)
                held.append(np.frombuffer(raw, f"<u{len(raw) // n}"))
                size += n
                if size >= SHARD_IDS:
                    yield flush()
                    first, place = first + size, place + 1
                    names, held, size = [], [], 0
        if held:
            yield flush()

    rows = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids")
    rows.mapInArrow(run, SHARDS).write.option("compression", "uncompressed").parquet(f"{folder}/shards")
    used = np.flatnonzero(code.lengths)
    spark.createDataFrame([(int(i), int(code.lengths[i])) for i in used], "id long, length int").coalesce(1).write.parquet(f"{folder}/lengths")


def read_code(spark: SparkSession, folder: str) -> Code:
    found = spark.read.schema("id long, length int").parquet(f"{folder}/lengths").toArrow()  # at most the vocabulary
    ids = found.column("id").to_numpy()
    lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint8)
    lengths[ids] = found.column("length").to_numpy()
    return Code(lengths)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    ship_package(spark)
    packed = spark.sparkContext.broadcast(read_code(spark, folder))
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4):
            for part, first, shard in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
                names, sizes, ids = read_shard(packed.value, shard)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(first + ends - sizes),
                                                  pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())],
                                                 ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "first_id", "shard").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = os.environ.get("BYTE_BPE_FILE") or public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, 2)


def round_trip(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Encode, write, read back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    coded = stash(tokenize(docs, path, end), "token-ids")
    found = count_ids(coded).toArrow()  # at most the vocabulary
    counts = np.zeros(int(max(found.column("id").to_numpy(), default=0)) + 1, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    folder = shared_folder(spark, "token-shards")
    write_shards(coded, Code(code_lengths(counts)), folder)
    rows = read_documents(spark, folder)
    # one row a part: ids before it, from the parts' own totals in range order
    parts = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    totals = sorted(map(tuple, parts.groupBy("part").agg(F.sum("n_ids")).collect()))
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
