"""Mergeable weighted quantile sketch per (group, feature).

A double's bits, read in ascending order, are a digit string.  A first pass
counts weight by the leading ``BITS`` digits (task sums first, then one
exchange); a bucket that holds more weight than one bin and more than one value is opened
by the next digits, until none is left.  Buckets are weights by addition and
bounds by minimum and maximum, all whole numbers, so that the sketch does not
depend on partitions, order or retries.  A cut is the largest value of its
bucket, a value of the data; no bin exceeds its share of the weight by more
than one bucket, which is below a bin's share or a single value.

The tables have at most groups x features x 2^BITS rows, in practice a few
thousand a feature (values of one sign within some octaves).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.batches import x_block
from riskfold.session import materialize, settle, ship_package

#: Leading digits of the passes: sign, exponent and 8 of the mantissa first, all digits last.
BITS = (20, 36, 52, 64)
#: Steps of a unit of weight.
WEIGHT_UNIT = 1024
_SCHEMA = "g int, j int, bucket long, n long, lo long, hi long"


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles; -0.0 equals 0.0."""
    raw = (x + 0.0).view(np.int64)
    return raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def value_of(bits: np.ndarray) -> np.ndarray:
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _counts(train: DataFrame, bits: int, opened: dict | None) -> DataFrame:
    """(g, j, bucket, n, lo, hi) by the leading ``bits``; with ``opened``
    ({(g, j): (bits before, buckets)}) only the values in those buckets."""
    shift = 64 - bits

    def task(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = x_block(batch)
            g = batch.column("g").to_numpy(zero_copy_only=False)
            w = np.rint(batch.column("w0").to_numpy(zero_copy_only=False).astype(np.float64) * WEIGHT_UNIT).astype(np.int64)
            for gv in np.unique(g):
                mine = ordered_bits(np.ascontiguousarray(x[g == gv]))
                weight = w[g == gv]
                for j in range(mine.shape[1]):
                    v, wj = mine[:, j], weight
                    if opened is not None:
                        before, buckets = opened.get((int(gv), j), (bits, ()))
                        inside = np.isin(v >> (64 - before), buckets) if len(buckets) else np.zeros(len(v), bool)
                        v, wj = v[inside], wj[inside]
                    if not len(v):
                        continue
                    order = np.argsort(v, kind="stable")
                    v, wj = v[order], wj[order]
                    bucket = v >> shift
                    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    last = np.append(first[1:], len(v)) - 1
                    held.setdefault((int(gv), j), []).append((bucket[first], np.add.reduceat(wj, first), v[first], v[last]))
            if sum(len(p[0]) for parts in held.values() for p in parts) > 500_000:
                yield merged(held)
                held.clear()
        if held:
            yield merged(held)

    def merged(held):
        out = []
        for (g, j), parts in held.items():
            bucket, n, lo, hi = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(bucket, kind="stable")
            bucket, n, lo, hi = bucket[order], n[order], lo[order], hi[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out.append((np.full(len(first), g), np.full(len(first), j), bucket[first], np.add.reduceat(n, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)))
        g, j, *rest = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(j, pa.int32()), *[pa.array(r, pa.int64()) for r in rest]], ["g", "j", "bucket", "n", "lo", "hi"])

    ship_package(train.sparkSession)
    parts = train.select("g", "w0", "x").mapInArrow(task, _SCHEMA)
    return parts.groupBy("g", "j", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def feature_cuts(train: DataFrame, n_features: int, max_bins: int = 32) -> dict[int, np.ndarray]:
    """{g: array (features, max_bins - 1)} of ascending cuts at equal shares
    of the weight ``w0`` of the rows (g, w0, x); equal cuts repeat."""
    leaves, opened, before = None, None, 0
    for bits in BITS:
        found = materialize(_counts(train, bits, opened), keep_cached=False)
        if leaves is None:
            totals = settle(found.groupBy("g", "j").agg(F.sum("n").alias("total")))
        heavy = found.join(F.broadcast(totals), ["g", "j"]).where((F.col("n") * max_bins > F.col("total")) & (F.col("lo") < F.col("hi")))
        rows = heavy.select("g", "j", "bucket").collect() if bits < 64 else []   # fewer than max_bins a feature
        closed = found.join(F.broadcast(heavy.select("g", "j", "bucket")), ["g", "j", "bucket"], "left_anti") if rows else found
        leaves = closed if leaves is None else leaves.unionByName(closed)
        if not rows:
            break
        opened, before = {}, bits
        for r in rows:
            opened.setdefault((r["g"], r["j"]), (before, []))[1].append(r["bucket"])
    run = Window.partitionBy("g", "j").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    at = leaves.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(totals), ["g", "j"])
    low = F.expr(f"(upto - n) * {max_bins} div total + 1")
    high = F.least(F.expr(f"upto * {max_bins} div total"), F.lit(max_bins - 1))
    cuts = at.select("g", "j", "hi", low.alias("a"), high.alias("b")).where("a <= b").select("g", "j", "hi", F.explode(F.sequence("a", "b")).alias("i"))
    out: dict[int, np.ndarray] = {}
    for r in cuts.collect():   # groups x features x cuts
        out.setdefault(r["g"], np.zeros((n_features, max_bins - 1)))[r["j"], r["i"] - 1] = value_of(np.array([r["hi"]]))[0]
    return out
