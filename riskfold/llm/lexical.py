"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector over the terms that the queries ask for; its
coordinate is the term's weight times the document's saturated count, an
integer.  A query is the set of its terms, so a score is the inner product
with a 0/1 vector.  Tasks cut their documents into blocks and grow a ball tree
over each: a node holds a centroid and the radius around it, and is split at
the median between two distant documents.  No document of a node can score
more for query q than

    q . centroid + |q restricted to the node's terms| x radius,

where the radius and the bound are rounded up (``SLACK``).  For each query a
task walks its trees best-first: subtrees whose bound lies below the query's
k-th score so far are pruned, equal bounds are still opened for the sake of
the tie rule, and documents at the leaves are scored in exact 64-bit integers.
The k best of each task are merged by a window.

Queries are answered in blocks of bounded size (``ITEMS`` queries and
``CHARS`` characters, or one longer query), whose terms are broadcast; all
documents meet each block.  Counts (N, L, df) cover all documents: each task
sums its own and the sums are exchanged by term.

Null texts and texts without a term are no documents of N, and score nothing.
Null doc ids come last among equal scores.  Queries that repeat id and text
are one query; a query without terms returns no row.  Repeated document rows
each take a rank.  An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.common import documents, stash
from riskfold.session import ship_package

ITEMS, CHARS, K = 2_000, 4_000_000, 10
#: Documents and coordinates of a block, documents of a leaf.
BLOCK_ROWS, BLOCK_TERMS, LEAF = 4_096, 2_000_000, 64
SLACK = 1e-9
#: Terms over the bytes of a text; bytes from 0x80 on belong to code points beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_DOCUMENT, _TERM_COUNT, _TOTAL = 0, 1, 2
_VECTOR = "kind byte, doc_id long, n long, docs long, terms binary, counts binary"


def terms(text: str | bytes | None) -> list[bytes]:
    """Terms of a whole text, only A-Z lower-cased (bytes.lower knows no others)."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return _TERM.findall(raw.lower())


@dataclass
class Queries:
    """A block of queries: ids, and their terms as places of ``places``."""

    ids: list
    places: dict[bytes, int]
    starts: np.ndarray
    cols: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Queries:
        ids, places, starts, cols = [], {}, [0], []
        for name, text in rows:
            found = sorted(set(terms(text)))
            if found:
                ids.append(name)
                cols += [places.setdefault(t, len(places)) for t in found]
                starts.append(len(cols))
        return cls(ids, places, np.array(starts[:-1], np.int64), np.array(cols, np.int64))

    def of_item(self, i: int) -> np.ndarray:
        return self.cols[self.starts[i]:self.starts[i + 1] if i + 1 < len(self.starts) else len(self.cols)]


def vectors(docs: DataFrame, places, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of three kinds: documents that hold a query term (doc_id, n terms,
    places and counts), documents of each task that hold a term (place in
    doc_id, number in n), and each task's totals (documents in docs, terms in n)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        holding, total, rows = np.zeros(len(known), np.int64), 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, sizes, cols, counts = [], [], [], []
                for name, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                    found = terms(raw)
                    if not found:
                        continue
                    total, rows = total + len(found), rows + 1
                    seen = Counter(filter(known.__contains__, found))
                    if seen:
                        at = np.fromiter(map(known.__getitem__, seen), np.int32, len(seen))
                        holding[at] += 1
                        ids.append(name), sizes.append(len(found)), cols.append(at.tobytes())
                        counts.append(np.fromiter(seen.values(), np.int64, len(seen)).astype("<i4").tobytes())
                yield made(_DOCUMENT, ids, sizes, [None] * len(ids), cols, counts)
        at = np.flatnonzero(holding)
        none = [None] * len(at)
        yield made(_TERM_COUNT, at, holding[at], none, none, none)
        yield made(_TOTAL, [None], [total], [rows], [None], [None])

    def made(kind, ids, n, rows, cols, counts) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(ids), pa.int8()), *[pa.array(x, pa.int64()) for x in (ids, n, rows)], *[pa.array(x, pa.binary()) for x in (cols, counts)]]
        return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "n", "docs", "terms", "counts"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _VECTOR)


def weights(found: DataFrame, width: int) -> tuple[np.ndarray, int, int]:
    """(weight of each place, N, L) from the rows of ``vectors``."""
    n, size = found.where(F.col("kind") == _TOTAL).agg(F.sum("docs"), F.sum("n")).first()
    n, size = n or 0, size or 0
    out = np.zeros(width, np.int64)
    for r in found.where(F.col("kind") == _TERM_COUNT).groupBy("doc_id").agg(F.sum("n").alias("df")).collect():  # a row a term of the block
        out[r["doc_id"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    return out, n, size


class Tree:
    """Ball tree over the rows of a block (``starts``, ``cols``, ``vals``);
    every row has a coordinate.  ``bounds[node]`` has an upper bound a query."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int, queries: Queries, leaf: int = LEAF) -> None:
        self.width, self.queries, self.leaf = width, queries, leaf
        self.starts, self.cols, self.vals = starts, cols, vals
        self.x = vals.astype(np.float64)
        self.sizes = np.diff(np.append(starts, len(cols)))
        self.square = np.add.reduceat(self.x * self.x, starts)
        self.bounds: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self._grow(np.arange(len(starts)))

    def _flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' coordinates, and where each row starts in them."""
        size = self.sizes[rows]
        starts = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.starts[rows] - starts, size), starts

    def _grow(self, rows: np.ndarray) -> int:
        node = len(self.bounds)
        flat, starts = self._flat(rows)
        cols, x = self.cols[flat], self.x[flat]
        centre = np.bincount(cols, x, self.width) / len(rows)
        own = float(centre @ centre)
        away = self.square[rows] - 2 * np.add.reduceat(x * centre[cols], starts) + own
        radius = math.sqrt(max(float(away.max()), 0.0) + SLACK * (float(self.square[rows].max()) + own))
        q = self.queries
        reach = np.sqrt(np.add.reduceat((centre > 0)[q.cols], q.starts)) * radius
        self.bounds.append((np.add.reduceat(centre[q.cols], q.starts) + reach) * (1 + SLACK) + 1)
        self.children.append(None)
        if len(rows) <= self.leaf or away.max() <= SLACK * own:
            self.leaves[node] = (rows, starts, cols, self.vals[flat])
            return node
        a = rows[int(away.argmax())]
        line = self._dense(a)
        far = self.square[rows] - 2 * np.add.reduceat(x * line[cols], starts)
        line -= self._dense(rows[int(far.argmax())])
        order = np.argsort(np.add.reduceat(x * line[cols], starts), kind="stable")
        half = len(rows) // 2
        self.children[node] = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
        return node

    def _dense(self, row: int) -> np.ndarray:
        at = slice(self.starts[row], self.starts[row] + self.sizes[row])
        out = np.zeros(self.width)
        out[self.cols[at]] = self.x[at]
        return out


class Best:
    """The k best (score, id) of a query so far."""

    __slots__ = ("k", "scores", "ids", "none")

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """Scores below this can't enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        by = np.lexsort((ids, none, -scores))[:self.k]
        self.scores, self.ids, self.none = scores[by], ids[by], none[by]


def search(tree: Tree, ids: np.ndarray, none: np.ndarray, found: list[Best]) -> int:
    """Add a block's documents to the best of every query; returns the leaves opened."""
    bounds, opened = np.array(tree.bounds), 0
    wanted = np.zeros(tree.width, np.int64)
    for i, best in enumerate(found):
        ask = tree.queries.of_item(i)
        wanted[ask] = 1
        bound = bounds[:, i].tolist()
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < best.floor:
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if bound[child] >= best.floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            opened += 1
            rows, starts, cols, vals = tree.leaves[node]
            scores = np.add.reduceat(vals * wanted[cols], starts)
            good = np.flatnonzero(scores >= best.floor)
            if len(good):
                best.add(scores[good], ids[rows[good]], none[rows[good]])
        wanted[ask] = 0
    return opened


def _block(rows: list, weight: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, which are null, row starts, columns and integer coordinates; columns of weight zero and rows without another are left out."""
    cols = np.frombuffer(b"".join(r[2] for r in rows), "<i4").astype(np.int64)
    tf = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64)
    size = np.array([len(r[2]) // 4 for r in rows], np.int64)
    m = np.array([10 + 90 * r[1] * n_docs // n_terms for r in rows], np.int64)
    vals = weight[cols] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size)))
    row = np.repeat(np.arange(len(rows)), size)[vals > 0]
    kept, starts = np.unique(row, return_index=True)
    ids = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
    none = np.array([r[0] is None for r in rows])
    return ids[kept], none[kept], starts, cols[vals > 0], vals[vals > 0]


def _answer(docs: DataFrame, items: list, id_type: str, k: int, text: str, doc_id: str, block_rows: int, leaf: int) -> DataFrame | None:
    """The k best (item, doc_id, score) of each task for one block of queries."""
    queries = Queries.of(items)
    if not queries.ids:
        return None
    spark = docs.sparkSession
    found = stash(vectors(docs, spark.sparkContext.broadcast(queries.places), text, doc_id), "lexical-vectors")
    weight, n_docs, n_terms = weights(found, len(queries.places))
    packed = spark.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = packed.value
        best = [Best(k) for _ in queries.ids]
        held, size = [], 0

        def settle() -> None:
            ids, none, starts, cols, vals = _block(held, weight, n_docs, n_terms)
            if len(starts):
                search(Tree(starts, cols, vals, len(weight), queries, leaf), ids, none, best)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                held.append(row)
                size += len(row[2]) // 4
                if len(held) >= block_rows or size >= BLOCK_TERMS:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        for i, x in enumerate(best):
            if len(x.scores):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x.ids), pa.int32()), pa.array(x.ids, pa.int64(), mask=x.none), pa.array(x.scores)], ["item", "doc_id", "score"])

    each = found.where(F.col("kind") == _DOCUMENT).select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")
    names = spark.createDataFrame([(i, name) for i, name in enumerate(queries.ids)], f"item int, item_id {id_type}")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most ITEMS rows of names


def search_documents(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
                     most_items: int = ITEMS, most_chars: int = CHARS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").dropDuplicates(["item_id", "text"])
    own = stash(own.withColumn("at", F.xxhash64("item_id", "text")), "lexical-items")
    id_type = own.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    spans = [(-(1 << 63), (1 << 63) - 1)]
    while spans:  # blocks of the items' hash range, halved until a block is small enough
        low, high = spans.pop()
        part = own.where(F.col("at").between(low, high))
        n, chars = part.agg(F.count("*"), F.sum(F.length("text"))).first()
        if n > 1 and (n > most_items or chars > most_chars) and low < high:
            spans += [(low, (low + high) // 2), ((low + high) // 2 + 1, high)]
        elif n:
            rows = sorted([(r["item_id"], r["text"]) for r in part.collect()], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
            made = _answer(docs, rows, id_type, k, text, doc_id, block_rows, leaf)
            out = out if made is None else out.unionByName(made)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_CLASS}') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT DISTINCT item, unnest(regexp_extract_all({_LOWER.format('text')}, '{_CLASS}')) AS t FROM i),
o AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY k, t),
f AS (SELECT t, count(*) AS df FROM o GROUP BY t),
s AS (SELECT item, o.k, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * len(w) * n_docs)::BIGINT // n_terms::BIGINT)))))::BIGINT AS score
      FROM q JOIN o USING (t) JOIN f USING (t) JOIN d ON d.k = o.k, c GROUP BY item, o.k),
r AS (SELECT item, k, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id FROM s JOIN d USING (k) WHERE score > 0)
SELECT i.item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN i USING (item) WHERE rank <= 10
"""
