"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by length (norm) into buckets of at most ``BUCKET`` rows, a
bucket is one row of a shared table.  Every query first meets the bucket of
the longest vectors; its k-th score there is a threshold that the answer can
only exceed.  Then each group of queries visits the buckets, and per bucket
and query the local cosine threshold, threshold / (query norm x longest norm),
decides: above 1 the bucket is skipped; from ``COORDINATE_FROM`` on candidates
are pruned by the feasible interval of the query's largest coordinates; below
it by length alone.  Products of what is left are verified exactly, and the
best k of each bucket are merged.  Bounds carry a relative slack of 1e-9, so
rounding loses nothing; equal scores are kept for the tie rule.

Vectors null, empty, or holding null or non-finite components, and null ids,
take no part.  Vectors of different dimension do not meet.  Rows with the
query's id are its own and no candidates; other repeated ids are candidates
row by row, a repeated query is asked once.  Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.common import stash
from riskfold.session import ship_package

BUCKET, GROUP, FOCUS, COORDINATE_FROM, SLACK = 1024, 512, 4, 0.3, 1e-9
EXACT = float(1 << 53)
#: Dimensions up to which the first buckets (one each) are broadcast.
MOST_DIMS = 16
_BLOCK = "bucket long, dim int, ids binary, data binary, longest double, shortest double"


def scaled(vectors: DataFrame, column: str = "embedding", vec_id: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim, norm): floor(scale * x) of the vectors that take part."""
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("x")).where(F.col("vec_id").isNotNull())
    sound = F.coalesce((F.size("x") > 0) & F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False))
    own = own.where(sound).withColumn("v", F.transform("x", lambda e: F.floor(e.cast("double") * scale).cast("double"))).drop("x")
    return own.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (vec_id, v, dim, norm), as their partitions hold them, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, data, norms = (np.concatenate(x) for x in zip(*held.pop(dim)))
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                                               pa.array([data.tobytes()], pa.binary()), pa.array([norms.max()]), pa.array([norms.min()])],
                                              ["bucket", "dim", "ids", "data", "longest", "shortest"])

        part = 0
        for b in batches:
            for lo in range(0, b.num_rows, most):
                s = b.slice(lo, most)
                part = s.column(0)[0].as_py()
                ids, dims, norms = (s.column(c).to_numpy() for c in (1, 3, 4))
                flat = s.column(2).flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(dims)[:-1]])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    data = flat[starts[at][:, None] + np.arange(dim)]
                    while len(at):
                        have = sum(len(x[0]) for x in held.get(int(dim), ()))
                        take = min(most - have, len(at))
                        held.setdefault(int(dim), []).append((ids[at[:take]].astype(np.int64), data[:take].ravel(), norms[at[:take]]))
                        at, data = at[take:], data[take:]
                        if have + take == most:
                            yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    ship_package(rows.sparkSession)
    return rows.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "v", "dim", "norm").mapInArrow(run, _BLOCK)


def _unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of one query with candidates."""
    limit = np.linalg.norm(q) * (np.sqrt((c * c).sum(1).max()) if len(c) else 0.0)
    if limit < EXACT:
        return (c @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in c]
    if any(abs(x) >= 1 << 63 for x in exact):
        raise OverflowError("a score does not fit a long")
    return np.array(exact, np.int64)


def survivors(q: np.ndarray, data: np.ndarray, norms: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the candidates (longest first) whose product may reach the threshold."""
    size = float(np.linalg.norm(q))
    if threshold <= 0 or threshold == -np.inf:
        return np.arange(len(data))
    if size == 0 or not len(norms) or norms[0] == 0:
        return np.arange(0)
    local = threshold * (1 - SLACK) / (size * norms[0])
    if local > 1:
        return np.arange(0)
    kept = np.arange(np.searchsorted(-norms, -threshold * (1 - SLACK) / size, "right"))  # long enough even if parallel
    if local < COORDINATE_FROM:
        return kept
    unit = q / size
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        reach = np.sqrt(max(0.0, (1 - local * local) * (1 - unit[f] * unit[f]))) + 1e-9
        coordinate = data[kept, f] / norms[kept]
        low, high = unit[f] * local - reach, unit[f] * local + reach
        # a cosine above the threshold can lie beyond the interval's far end, up to the coordinate of the query itself
        low, high = (low, max(high, 1.0)) if unit[f] >= 0 else (min(low, -1.0), high)
        kept = kept[(coordinate >= low) & (coordinate <= high)]
    return kept


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _longest_first(ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    norms = np.sqrt((data * data).sum(1))
    by = np.argsort(-norms, kind="stable")
    return ids[by], data[by], norms[by]


def shortest_useful(q: np.ndarray, least: np.ndarray) -> float:
    """The norm that a candidate needs to reach the threshold of some query of
    the group, even if parallel to it."""
    size = np.sqrt((q * q).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(least <= 0, 0.0, np.where(size > 0, least / size, np.inf))
    return float(need.min(initial=np.inf))


def visited(groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """(at, bucket): query groups (at, dim, need) and the buckets (dim,
    bucket, longest) whose longest vector may be long enough."""
    return groups.join(buckets, "dim").where(F.col("longest") * (1 + 2 * SLACK) >= F.col("need")).select("at", "bucket")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, column: str = "embedding", vec_id: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (over
    vec_id) holds, against all rows."""
    rows = stash(scaled(vectors, column, vec_id, scale), "topk-vectors")
    count, asked = rows.agg(F.count("*"), F.sum(is_query.cast("long"))).first()
    dealt = rows.repartitionByRange(max(1, -(-count // (4 * BUCKET))), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
    buckets = stash(_blocks(dealt, BUCKET), "topk-buckets")
    queries = rows.where(is_query).dropDuplicates(["vec_id"]).repartitionByRange(max(1, -(-(asked or 0) // (4 * GROUP))), "vec_id")
    groups = _blocks(queries, GROUP).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # one bucket a dimension: the one of the longest vectors
    first = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "data"), "longest").alias("b")).select("dim", "b.*")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, q_ids, q_data, ids, data = (b.column(c)[i].as_py() for c in range(5))
                qi, q = _unpack(q_ids, q_data, dim)
                ci, c = _unpack(ids, data, dim)
                least = np.full(len(qi), -np.inf)
                for n in range(len(qi)):
                    scores = products(q[n], c)[ci != qi[n]]
                    if len(scores) >= k:
                        least[n] = np.partition(scores, len(scores) - k)[len(scores) - k]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([q_ids], pa.binary()), pa.array([q_data], pa.binary()),
                                                  pa.array([least.tobytes()], pa.binary()), pa.array([shortest_useful(q, least)])],
                                                 ["dim", "q_ids", "q_data", "least", "need"])

    few = buckets.select("dim").distinct().limit(MOST_DIMS + 1).count() <= MOST_DIMS  # a bucket a dimension
    met = groups.join(F.broadcast(first) if few else first, "dim").mapInArrow(bound, "dim int, q_ids binary, q_data binary, least binary, need double")
    asked_rows = stash(met.withColumn("at", F.monotonically_increasing_id()), "topk-queries")
    # which group must see which bucket is settled on the norms alone, before any block moves
    pairs = visited(asked_rows.select("at", "dim", "need"), buckets.select("dim", "bucket", "longest"))
    visits = pairs.join(asked_rows.drop("need", "dim"), "at").join(buckets.select("bucket", "dim", "ids", "data"), "bucket")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, q_ids, q_data, least, ids, data = (b.column(c)[i].as_py() for c in range(6))
                qi, q = _unpack(q_ids, q_data, dim)
                ci, c, norms = _longest_first(*_unpack(ids, data, dim))
                floor = np.frombuffer(least, np.float64)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for n in range(len(qi)):
                    at = survivors(q[n], c, norms, floor[n])
                    at = at[ci[at] != qi[n]]
                    if not len(at):
                        continue
                    scores = products(q[n], c[at])
                    good = np.flatnonzero(scores >= floor[n])
                    good = good[best(scores[good], ci[at[good]], k)]
                    found.append((np.full(len(good), qi[n]), ci[at[good]], scores[good]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "vec_id", "score"])

    ship_package(vectors.sparkSession)
    each = visits.select("dim", "q_ids", "q_data", "least", "ids", "data").mapInArrow(visit, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
