"""Exact, linearly interpolated quantiles per group by radix selection.

A double's bits, read in ascending order, are a digit string.  The first pass
counts the values of each (group, column) by their leading ``BITS`` digits;
running sums over these counts find the bucket that holds each wanted order
statistic.  Only those buckets are opened by the next digits, until a bucket
holds one value.  No table of distinct values, no sort of the data and no
group in one task: a task keeps counters, a pass exchanges at most
groups x columns x 2^BITS counters (in practice a few thousand a column: the
octaves that the values span), later ones opened buckets x 2^16.

With ``folds`` each row is counted once, under its own fold, and the values of
fit group g are those of all folds less fold g (-1: all of them): counts are
subtracted, so no row is copied into the groups that it trains.

Definition (numpy/pandas 'linear', Spark ``percentile``, DuckDB
``quantile_cont``): with n non-null values sorted, pos = p*(n-1),
q = v[floor(pos)] + (pos - floor(pos)) * (v[ceil(pos)] - v[floor(pos)]).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.sketch import ordered_bits, value_of
from riskfold.session import materialize, settle, ship_package

#: Leading digits of the passes; the last pass has them all.
BITS = (20, 36, 52, 64)
#: Counters that a task holds before it hands them on.
_HELD = 300_000


def _group_codes(columns: list[pa.Array], n: int) -> tuple[np.ndarray, list[tuple]]:
    """A number per row for its group, and the groups by number."""
    code, known = np.zeros(n, np.int64), [()]
    for col in columns:
        own = col.dictionary_encode()
        at = own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        values = [*own.dictionary.to_pylist(), None]
        code, back = np.unique(code * len(values) + at, return_inverse=True)
        known = [(*known[c // len(values)], values[c % len(values)]) for c in code.tolist()]
        code = back.ravel()
    return code, known


def _counted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str | None, bits: int, before: int, opened: dict | None) -> DataFrame:
    """(keys..., j, bucket, n, lo, hi): counts and extremes by the leading
    ``bits``; with ``opened`` {(group, j): buckets of ``before`` digits} only
    of the values in those buckets."""
    keys, shift = list(keys), 64 - bits
    own = T.StructType([*[df.schema[k] for k in keys], T.StructField("j", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("bucket", "n", "lo", "hi")]])
    key_types = None

    def merged(held):
        g, j, bucket, n, lo, hi = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((bucket, j, g))
        g, j, bucket, n, lo, hi = (x[order] for x in (g, j, bucket, n, lo, hi))
        first = _changes(g, j, bucket)
        return g[first], j[first], bucket[first], np.add.reduceat(n, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, places, held, size = [], {}, [], 0

        def flush():
            g, *rest = merged(held)
            named = [groups[i] for i in g.tolist()]
            cols = [pa.array([x[i] for x in named], key_types[i]) for i in range(len(keys))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([*cols, *[pa.array(r, k) for r, k in zip(rest, kinds)]], [*keys, "j", "bucket", "n", "lo", "hi"])

        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            code, known = _group_codes([batch.column(k) for k in keys], batch.num_rows)
            for x in known:
                if x not in places:
                    places[x] = len(groups)
                    groups.append(x)
            own_place = np.array([places[x] for x in known], np.int64)
            code = own_place[code]
            w = None if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            for j, c in enumerate(columns):
                col = batch.column(c)
                at = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
                v = ordered_bits(col.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64))
                g, wj = code[at], np.ones(len(at), np.int64) if w is None else w[at]
                if opened is not None:
                    inside = np.zeros(len(v), bool)
                    for x in known:
                        buckets = opened.get((x, j))
                        if buckets is not None:
                            mine = np.flatnonzero(g == places[x])
                            inside[mine] = np.isin(v[mine] >> (64 - before), buckets)
                    v, g, wj = v[inside], g[inside], wj[inside]
                if not len(v):
                    continue
                order = np.lexsort((v, g))
                v, g, wj = v[order], g[order], wj[order]
                bucket = v >> shift
                first = _changes(g, bucket)
                last = np.append(first[1:], len(v)) - 1
                held.append((g[first], np.full(len(first), j), bucket[first], np.add.reduceat(wj, first), v[first], v[last]))
                size += len(first)
            if size > _HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    ship_package(df.sparkSession)
    picked = df.select(*keys, *([weight] if weight else []), *columns)
    return picked.mapInArrow(run, own).groupBy(*keys, "j", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _complements(counts: DataFrame, keys: list[str], fold: str, groups: list[int]) -> DataFrame:
    """Counts of each fit group: all folds less its own.  A bucket's extremes
    are those of the other folds."""
    others = F.array(*[F.lit(g) for g in groups])
    each = counts.withColumn("g", F.explode(F.filter(others, lambda g: g != F.col(fold))))   # counters, not rows
    return each.groupBy(*keys, "g", "j", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def select_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], weight: str | None = None,
                 folds: tuple[str, list[int]] | None = None) -> DataFrame:
    """(keys..., [g,] j, p, frac, lo, hi): the two order statistics beside
    position p*(n-1) of every group and column ``j`` (place in ``columns``);
    ``folds`` = (fold column, fit groups)."""
    named, spark = list(keys), df.sparkSession
    keys = [f"k{i}" for i in range(len(named))]   # the caller's names can't clash with the counters'
    values = [f"v{i}" for i in range(len(columns))]
    df = df.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(named, keys)], *([F.col(f"`{folds[0]}`").alias("fold")] if folds else []),
                   *([F.col(f"`{weight}`").alias("w")] if weight else []), *[F.col(f"`{c}`").cast("double").alias(v) for c, v in zip(columns, values)])
    columns, weight, folds = values, "w" if weight else None, ("fold", folds[1]) if folds else None
    counted = [*keys, "fold"] if folds else keys
    grouped = [*keys, "g"] if folds else keys
    upto = Window.partitionBy(*grouped, "j").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    wanted, opened, before, done = None, None, 0, None
    for bits in BITS:
        counts = _counted(df, counted, columns, weight, bits, before, opened)
        if folds:
            counts = _complements(counts, keys, *folds)
        counts = materialize(counts, keep_cached=False)
        if wanted is None:
            sizes = counts.groupBy(*grouped, "j").agg(F.sum("n").alias("size"))
            pos = F.col("p") * (F.col("size") - 1)
            sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(pos).alias("r")), F.struct(F.lit(1).alias("side"), F.ceil(pos).alias("r")))
            each = sizes.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
            wanted = each.select(*grouped, "j", "p", (pos - F.floor(pos)).alias("frac"), F.explode(sides).alias("s"), F.lit(None).cast("long").alias("parent"))
            wanted = settle(wanted.select(*grouped, "j", "p", "frac", "s.side", F.col("s.r").cast("long").alias("r"), "parent"))
        # a rank counts from the start of the bucket that was opened for it
        parent = F.shiftright("bucket", bits - before) if before else F.lit(None).cast("long")
        run = upto if not before else Window.partitionBy(*grouped, "j", "parent").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
        sums = counts.withColumn("parent", parent).withColumn("upto", F.sum("n").over(run))
        a, b = sums.alias("a"), F.broadcast(wanted).alias("b")
        alike = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*grouped, "j", "parent"]]
        within = (F.col("b.r") >= F.col("a.upto") - F.col("a.n")) & (F.col("b.r") < F.col("a.upto"))
        hit = a.join(b, [*alike, within]).select(*[F.col(f"b.{c}") for c in [*grouped, "j", "p", "frac", "side"]], F.col("a.bucket").alias("parent"),
                                                 (F.col("b.r") - (F.col("a.upto") - F.col("a.n"))).alias("r"), "a.lo", "a.hi")
        hit = settle(hit)   # groups x columns x probabilities x 2 rows
        one = hit.where("lo = hi")
        done = one if done is None else done.unionByName(one)
        wanted = hit.where("lo < hi").drop("lo", "hi")
        rows = wanted.select(*keys, "j", "parent").distinct().collect()
        if not rows:
            break
        wanted, opened, before = settle(wanted), {}, bits
        for r in rows:
            names = [tuple(r[k] for k in keys)]
            if folds:   # a fit group's bucket is opened in every fold
                names = [(*names[0], f) for f in range(-1, 1 + max(folds[1]))]
            for x in names:
                opened.setdefault((x, r["j"]), []).append(r["parent"])
    both = done.groupBy(*grouped, "j", "p").agg(F.max("frac").alias("frac"), F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("lo"),
                                                F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("hi"))
    rows = both.collect()
    found = value_of(np.array([[r["lo"], r["hi"]] for r in rows], np.int64).reshape(-1, 2))
    out = [(*[r[c] for c in (*grouped, "j", "p", "frac")], float(lo), float(hi)) for r, (lo, hi) in zip(rows, found)]
    names = dict(zip(keys, named))
    schema = T.StructType([*[T.StructField(names.get(c, c), both.schema[c].dataType) for c in (*grouped, "j")],
                           *[T.StructField(c, T.DoubleType()) for c in ("p", "frac", "lo", "hi")]])
    return spark.createDataFrame(out, schema)


def of_columns(ranks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``j`` replaced by the column's name."""
    return ranks.withColumn("column", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("j") + 1)).drop("j")


def interpolated(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).drop("lo", "hi", "frac")


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    weight_col: str | None = None) -> DataFrame:
    """Return ``group_cols + [p, q]``; NULL values are ignored, groups without
    values give no rows.  Evaluated eagerly; what reaches the driver is
    bounded by groups x probabilities."""
    return interpolated(select_ranks(df, list(group_cols), [value_col], probs, weight_col)).drop("j")


def quantile_columns(df: DataFrame, group_cols: list[str], value_col: str,
                     probs: dict[str, float], **kw) -> DataFrame:
    """Wide form: one column per named probability."""
    return _wide(exact_quantiles(df, group_cols, value_col, list(probs.values()), **kw), list(group_cols), probs)


def column_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: dict[str, float], folds: tuple[str, list[int]] | None = None) -> DataFrame:
    """(keys..., [g,] column, one column per named probability) of several
    columns in the same passes."""
    grouped = [*keys, *(["g"] if folds else []), "column"]
    return _wide(interpolated(of_columns(select_ranks(df, keys, columns, list(probs.values()), folds=folds), columns)), grouped, probs)


def _wide(long: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in probs.items()]
    return long.groupBy(*keys).agg(*aggs)
