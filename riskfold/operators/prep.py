"""Leakage-safe preprocessing, fitted for every fit group at once.

Input rows carry ``g`` (see ``split.train_view``/``apply_view``).  Fitted
state is a set of small tables keyed by ``(g, column)``; applying them is a
broadcast join of one row per group plus a projection, so no statistic is
ever recomputed on the rows being transformed.

Order inside a fit (as in the study): IQR fences -> clip -> median / mode
imputation -> binary codes / one-hot -> population-std scaling -> low-variance
filter -> greedy correlation pruning -> name sanitising.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.quantiles import column_quantiles, interpolated, of_columns, select_ranks
from riskfold.functions.batches import by_group, to_batch
from riskfold.session import materialize, settle, ship_package

KIND_RANK = {"numeric": 0, "binary": 1, "dummy": 2}


def long_values(df: DataFrame, ids: list[str], cols: list[str] | tuple[str, ...], cast: str = "double") -> DataFrame:
    """Unpivot ``cols`` into (ids..., column, value)."""
    cols = list(cols)
    narrow = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    return narrow.unpivot(ids, cols, "column", "value")


def widen(stats: DataFrame, stat_cols: list[str], columns: list[str] | tuple[str, ...]) -> DataFrame:
    """(g, column, stats...) -> one row per g with ``{stat}__{column}``."""
    aggs = [F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{s}__{c}")
            for c in columns for s in stat_cols]
    return stats.groupBy("g").agg(*aggs)


# --------------------------------------------------------------------------- fences
def iqr_bounds(train: DataFrame, columns: tuple[str, ...] | list[str], multiplier: float = 1.5,
               folds: tuple[str, list[int]] | None = None) -> DataFrame:
    """(g, column, q1, q3, lower, upper): Tukey fences from exact, linearly
    interpolated quartiles of the group's training rows (NULLs ignored).
    ``folds`` = (fold column, fit groups): ``train`` holds each development
    row once, and a group's rows are all folds less its own."""
    q = column_quantiles(train, [] if folds else ["g"], columns, {"q1": 0.25, "q3": 0.75}, folds)
    iqr = F.col("q3") - F.col("q1")
    return q.select("g", "column", "q1", "q3",
                    (F.col("q1") - F.lit(multiplier) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(multiplier) * iqr).alias("upper"))


def clip_expr(c: str, lower: str, upper: str) -> F.Column:
    """Clip to the fences; NULL stays NULL (``greatest/least`` would not)."""
    x = F.col(c)
    return F.when(x < F.col(lower), F.col(lower)).when(x > F.col(upper), F.col(upper)).otherwise(x)


def iqr_clip(rows: DataFrame, bounds: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Clip each listed column with its group's fences; rows never dropped."""
    if not columns:
        return rows
    wide = widen(bounds, ["lower", "upper"], columns)
    j = rows.join(F.broadcast(wide), "g", "left")
    for c in columns:
        j = j.withColumn(c, clip_expr(c, f"lower__{c}", f"upper__{c}"))
    return j.drop(*[f"{s}__{c}" for c in columns for s in ("lower", "upper")])


# --------------------------------------------------------------------------- imputation
def medians(train: DataFrame, numeric: tuple[str, ...] | list[str], folds: tuple[str, list[int]] | None = None,
            bounds: DataFrame | None = None) -> DataFrame:
    """(g, column, median) over non-null training values; with ``bounds`` the
    median of the clipped values: clipping keeps the order, so the two order
    statistics in the middle are clipped."""
    ranks = of_columns(select_ranks(train, [] if folds else ["g"], numeric, [0.5], folds=folds), numeric)
    if bounds is not None:
        ranks = ranks.join(F.broadcast(bounds.select("g", "column", "lower", "upper")), ["g", "column"], "left")
        for c in ("lo", "hi"):
            ranks = ranks.withColumn(c, clip_expr(c, "lower", "upper"))
    return interpolated(ranks).select("g", "column", F.col("q").alias("median"))


def category_counts(train: DataFrame, categorical: tuple[str, ...] | list[str], folds: tuple[str, list[int]] | None = None) -> DataFrame:
    """(g, column, value, n) for non-null categories (hash aggregate,
    combined map-side); with ``folds`` each row is counted once, under its own
    fold, and counters of the other folds are added up.  No categorical
    columns: an empty table."""
    if not categorical:
        return train.sparkSession.createDataFrame([], "g int, column string, value string, n long")
    own = folds[0] if folds else "g"
    lv = long_values(train, [own], categorical, cast="string").where(F.col("value").isNotNull())
    counts = lv.groupBy(own, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    if not folds:
        return counts
    others = F.filter(F.array(*[F.lit(g) for g in folds[1]]), lambda g: g != F.col(own))
    return counts.withColumn("g", F.explode(others)).groupBy("g", "column", "value").agg(F.sum("n").alias("n"))


#: Values that one column may have in one fit group: each becomes a feature.
MAX_CATEGORIES = 10_000


def bounded_categories(counts: DataFrame, most: int = MAX_CATEGORIES) -> DataFrame:
    """``counts`` as it is, or an error that names the column whose values are
    too many to be categories (an id-like column): nothing is cut off, and the
    driver and the broadcasts never get more than groups x columns x ``most``."""
    counts = materialize(counts, keep_cached=False)
    wide = counts.groupBy("g", "column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    worst = wide.groupBy("column").agg(F.max("n").alias("n")).orderBy("column").limit(5).collect()
    if worst:
        raise ValueError("not categorical: " + ", ".join(f"{r['column']} has {r['n']} values" for r in worst) + f" (at most {most})")
    return counts


def category_stats(counts: DataFrame) -> DataFrame:
    """(g, column, mode, n_distinct, v0, v1, fallback, is_binary): mode ties
    go to the smallest value; a column with exactly two values is binary,
    sorted order gives codes 0/1 and the mode's code is the fallback for
    unseen values."""
    st = counts.groupBy("g", "column").agg(
        F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))["v"].alias("mode"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min("value").alias("v0"),
        F.max("value").alias("v1"),
    )
    return st.withColumn("is_binary", F.col("n_distinct") == 2) \
             .withColumn("fallback", F.when(F.col("mode") == F.col("v0"), 0).otherwise(1))


def numeric_stats(train_clipped: DataFrame, med: DataFrame, numeric: tuple[str, ...] | list[str]) -> DataFrame:
    """(g, column, median, mean, sd): population std of the imputed values."""
    wide = widen(med, ["median"], numeric)
    j = train_clipped.join(F.broadcast(wide), "g", "left")
    aggs = []
    for c in numeric:
        x = F.coalesce(F.col(c), F.col(f"median__{c}"))
        aggs += [F.avg(x).alias(f"mean__{c}"), F.stddev_pop(x).alias(f"sd__{c}")]
    st = j.groupBy("g").agg(*aggs)
    stack = ", ".join(f"'{c}', `mean__{c}`, `sd__{c}`" for c in numeric)
    long = st.selectExpr("g", f"stack({len(numeric)}, {stack}) as (column, mean, sd)")
    return long.join(med, ["g", "column"], "left").select("g", "column", "median", "mean", "sd")


# --------------------------------------------------------------------------- fitted state
@dataclass
class Fitted:
    """Fitted state of every group; all members are small DataFrames."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    iqr_columns: tuple[str, ...]
    bounds: DataFrame | None      # (g, column, q1, q3, lower, upper)
    num: DataFrame                # (g, column, median, mean, sd)
    cat: DataFrame                # (g, column, mode, n_distinct, v0, v1, fallback, is_binary)
    counts: DataFrame             # (g, column, value, n)
    features: DataFrame           # (g, pos, feature, kind, column, value)

    def wide(self) -> DataFrame:
        """One row per group with every statistic as a column."""
        parts = []
        if self.numeric:
            parts.append(widen(self.num, ["median", "mean", "sd"], self.numeric))
        if self.bounds is not None and self.iqr_columns:
            parts.append(widen(self.bounds, ["lower", "upper"], self.iqr_columns))
        if self.categorical:
            parts.append(widen(self.cat, ["mode", "v0", "v1", "fallback", "is_binary"], self.categorical))
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, "g", "full")
        return out


def candidate_features(numeric, categorical, cat: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, pos, feature, kind, column, value): numeric columns, then binary
    columns, then one dummy per (multi-valued column, sorted value); a column
    with one value is one-hot too."""
    spark = cat.sparkSession
    parts = []
    if numeric:
        nums = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("col_pos"))
                         for i, c in enumerate(numeric)])
        parts.append(groups.select("g", F.explode(nums).alias("nc")).select(
            "g", F.lit("numeric").alias("kind"), "nc.column", "nc.col_pos",
            F.lit(None).cast("string").alias("value"), F.col("nc.column").alias("feature")))
    if categorical:
        cpos = spark.createDataFrame([(c, i) for i, c in enumerate(categorical)], "column string, col_pos int")
        c2 = cat.join(F.broadcast(cpos), "column")
        parts.append(c2.where("is_binary").select(
            "g", F.lit("binary").alias("kind"), "column", "col_pos",
            F.lit(None).cast("string").alias("value"), F.col("column").alias("feature")))
        multi = c2.where(~F.col("is_binary")).select("g", "column", "col_pos")
        d = counts.join(multi, ["g", "column"]).select(
            "g", F.lit("dummy").alias("kind"), "column", "col_pos", "value",
            F.concat(F.col("column"), F.lit("_"), F.col("value")).alias("feature"))
        parts.append(d)
    allf = parts[0]
    for p in parts[1:]:
        allf = allf.unionByName(p)
    kr = F.when(F.col("kind") == "numeric", 0).when(F.col("kind") == "binary", 1).otherwise(2)
    w = Window.partitionBy("g").orderBy(kr, "col_pos", "value")
    return allf.withColumn("pos", (F.row_number().over(w) - 1).cast("int")) \
               .select("g", "pos", "feature", "kind", "column", "value")


def fit(train: DataFrame, numeric, categorical, iqr_columns=(), multiplier: float = 1.5,
        dev: DataFrame | None = None, folds: tuple[str, list[int]] | None = None) -> Fitted:
    """Fit every group's preprocessor from its training rows (``g`` column).
    With ``dev`` and ``folds`` (fold column, fit groups) order statistics and
    counts come from the development rows, each read once, as all folds less
    the group's own."""
    numeric, categorical, iqr_columns = tuple(numeric), tuple(categorical), tuple(iqr_columns)
    once = train if folds is None else dev
    bounds = settle(iqr_bounds(once, iqr_columns, multiplier, folds)) if iqr_columns else None
    clipped = iqr_clip(train, bounds, iqr_columns) if iqr_columns else train
    med = settle(medians(once, numeric, folds, bounds))
    num = settle(numeric_stats(clipped, med, numeric))
    counts = settle(bounded_categories(category_counts(once, categorical, folds)))
    cat = settle(category_stats(counts))
    # group ids from the (small, settled) statistics: no extra pass over the rows
    groups = num.select("g").unionByName(cat.select("g")).distinct()
    feats = settle(candidate_features(numeric, categorical, cat, counts, groups))
    return Fitted(numeric, categorical, iqr_columns, bounds, num, cat, counts, feats)


# --------------------------------------------------------------------------- apply
def _num_expr(c: str, clipped: bool) -> F.Column:
    x = F.col(c).cast("double")
    if clipped:
        x = F.when(x < F.col(f"lower__{c}"), F.col(f"lower__{c}")) \
             .when(x > F.col(f"upper__{c}"), F.col(f"upper__{c}")).otherwise(x)
    x = F.coalesce(x, F.col(f"median__{c}"))
    sd = F.col(f"sd__{c}")
    return (x - F.col(f"mean__{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def _cat_value(c: str) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.col(f"mode__{c}"))


def _bin_expr(c: str) -> F.Column:
    y = _cat_value(c)
    return F.when(y == F.col(f"v0__{c}"), 0).when(y == F.col(f"v1__{c}"), 1) \
            .otherwise(F.col(f"fallback__{c}")).cast("double")


def transform_long(rows: DataFrame, fitted: Fitted, keep: list[str] | None = None) -> DataFrame:
    """(g, row_id, feature, value) for every candidate feature of the row's
    group: numeric and binary values from one projection, dummies from an
    equi-join with the group's category list (unseen category -> all zeros)."""
    keep = keep or []
    j = rows.join(F.broadcast(fitted.wide()), "g", "inner")
    ids = ["g", "row_id", *keep]
    parts = []
    if fitted.numeric:
        nv = j.select(*ids, *[_num_expr(c, c in fitted.iqr_columns).alias(c) for c in fitted.numeric])
        parts.append(nv.unpivot(ids, list(fitted.numeric), "feature", "value"))
    if fitted.categorical:
        cv = j.select(*ids, *[F.when(F.col(f"is_binary__{c}"), _bin_expr(c)).alias(c)
                              for c in fitted.categorical])
        parts.append(cv.unpivot(ids, list(fitted.categorical), "feature", "value")
                       .where(F.col("value").isNotNull()))
        mv = j.select(*ids, *[_cat_value(c).alias(c) for c in fitted.categorical])
        mv = mv.unpivot(ids, list(fitted.categorical), "column", "cval")
        dummies = fitted.features.where(F.col("kind") == "dummy").select("g", "column", "value", "feature")
        parts.append(mv.join(F.broadcast(dummies), ["g", "column"])
                       .select(*ids, "feature",
                               F.coalesce((F.col("cval") == F.col("value")).cast("double"), F.lit(0.0))
                               .alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def global_feature_list(fitted: Fitted) -> list[tuple[str, str, str | None]]:
    """Union of all groups' candidates as (kind, column, value), in the
    canonical order; collected (bounded by the category count)."""
    rows = fitted.features.select("kind", "column", "value").distinct().collect()
    cpos = {c: i for i, c in enumerate(fitted.numeric)}
    cpos.update({c: i for i, c in enumerate(fitted.categorical)})
    return sorted(((r["kind"], r["column"], r["value"]) for r in rows),
                  key=lambda t: (KIND_RANK[t[0]], cpos[t[1]], t[2] or ""))


def feature_name(kind: str, column: str, value: str | None) -> str:
    return column if kind != "dummy" else f"{column}_{value}"


def transform_array(rows: DataFrame, fitted: Fitted, flist, keep: list[str] | None = None, fill_numeric: bool = True) -> DataFrame:
    """(g, row_id, keep..., x array<double>) in the global order ``flist``;
    positions that are not a candidate of the row's group hold 0 (they are
    masked out by the selector).  ``fill_numeric`` off: a numeric value without
    any statistic to impute it from stays NULL."""
    keep = keep or []
    j = rows.join(F.broadcast(fitted.wide()), "g", "inner")
    exprs = []
    for kind, c, v in flist:
        if kind == "numeric":
            e = _num_expr(c, c in fitted.iqr_columns)
        elif kind == "binary":
            e = F.when(F.col(f"is_binary__{c}"), _bin_expr(c))
        else:
            e = F.when(~F.col(f"is_binary__{c}"), (_cat_value(c) == F.lit(v)).cast("double"))
        exprs.append(e if kind == "numeric" and not fill_numeric else F.coalesce(e, F.lit(0.0)))
    return j.select("g", "row_id", *keep, F.array(*exprs).alias("x"))


# --------------------------------------------------------------------------- selection
GRAM_SCHEMA = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("i", T.IntegerType()),
                            T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])


GRAM_ARROW = pa.schema([("g", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])


def _partial_gram(batches):
    """Per task: n, sum x and sum x x' per group, from Arrow batches with
    numpy.  Emits O(p^2) rows per group and task, never the rows."""
    acc: dict[int, list] = {}
    for g, part in by_group(batches, ["g"]):
        x = part.attrs["X"]
        a = acc.setdefault(g, [0, 0.0, 0.0])
        a[0] += x.shape[0]
        a[1] = a[1] + x.sum(axis=0)
        a[2] = a[2] + x.T @ x
    out = []
    for g, (n, sx, sxx) in acc.items():
        p = len(sx)
        iu, ju = np.triu_indices(p)
        out.append(pd.DataFrame({"g": g, "i": iu.astype(np.int32), "j": ju.astype(np.int32), "s": sxx[iu, ju]}))
        out.append(pd.DataFrame({"g": g, "i": np.full(p, -1, np.int32), "j": np.arange(p, dtype=np.int32), "s": sx}))
        out.append(pd.DataFrame({"g": [g], "i": [-1], "j": [-1], "s": [float(n)]}))
    if out:
        res = pd.concat(out, ignore_index=True)
        res["g"] = res["g"].astype(np.int32)
        res["i"] = res["i"].astype(np.int32)
        yield to_batch(res, GRAM_ARROW)


def gram(x_rows: DataFrame) -> DataFrame:
    """(g, i, j, s) sums: i=j=-1 row count, i=-1 column sums, i<=j cross
    products.  Per-task numpy partials over zero-copy Arrow blocks, then one
    small group-by."""
    ship_package(x_rows.sparkSession)
    parts = x_rows.select(F.col("g").cast("int").alias("g"), "x").mapInArrow(_partial_gram, GRAM_SCHEMA)
    return parts.groupBy("g", "i", "j").agg(F.sum("s").alias("s"))


def variances(x_rows: DataFrame) -> DataFrame:
    """(g, j, n, var_samp) from counts, sums and squares alone: p numbers a
    group and task, no products of columns.  Values are shifted by the task's
    own means before they are squared; partial sums are merged pairwise exact
    to rounding (sum of squares within plus between tasks).  A column ``w``
    says for how many rows a row stands."""
    ship_package(x_rows.sparkSession)
    weight = ["w"] if "w" in x_rows.columns else []

    def run(batches):
        acc: dict[int, list] = {}
        for g, part in by_group(batches, ["g", *weight]):
            x = part.attrs["X"]
            if weight:
                w = part["w"].to_numpy()
                n, mean = int(w.sum()), w @ x / w.sum()
                m2 = w @ (x - mean) ** 2
            else:
                n, mean = x.shape[0], x.mean(axis=0)
                m2 = ((x - mean) ** 2).sum(axis=0)
            if g in acc:
                n0, mean0, m20 = acc[g]
                both, delta = n0 + n, mean - mean0
                acc[g] = [both, mean0 + delta * n / both, m20 + m2 + delta ** 2 * n0 * n / both]
            else:
                acc[g] = [n, mean, m2]
        for g, (n, mean, m2) in acc.items():
            p = len(mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p, g, np.int32)), pa.array(np.arange(p, dtype=np.int32)), pa.array(np.full(p, n, np.int64)),
                                              pa.array(mean), pa.array(m2)], ["g", "j", "n", "mean", "m2"])

    parts = x_rows.select(F.col("g").cast("int").alias("g"), "x", *weight).mapInArrow(run, "g int, j int, n long, mean double, m2 double")
    whole = Window.partitionBy("g", "j")   # a row a task
    parts = parts.withColumn("all", F.sum("n").over(whole)).withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(whole) / F.col("all"))
    within = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2.0)))
    return parts.groupBy("g", "j").agg(F.max("all").cast("double").alias("n"), F.max("centre").alias("mean"),
                                       F.when(F.max("all") > 1, within / (F.max("all") - 1)).alias("var_samp"))


def moments(gr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From Gram sums: variances (g, j, n, var_samp) and correlations
    (g, i, j, r) for i<j (NULL when a side is constant)."""
    n = gr.where((F.col("i") == -1) & (F.col("j") == -1)).select("g", F.col("s").alias("n"))
    sx = gr.where((F.col("i") == -1) & (F.col("j") >= 0)).select("g", "j", F.col("s").alias("sx"))
    sq = gr.where((F.col("i") == F.col("j")) & (F.col("i") >= 0)).select("g", "j", F.col("s").alias("sxx"))
    var = (sx.join(sq, ["g", "j"]).join(n, "g")
             .withColumn("var_samp", (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) / (F.col("n") - 1))
             .withColumn("ss", F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")))
    cross = gr.where((F.col("i") >= 0) & (F.col("i") < F.col("j")))
    a = var.select("g", F.col("j").alias("i"), F.col("sx").alias("sx_i"), F.col("ss").alias("ss_i"))
    b = var.select("g", "j", F.col("sx").alias("sx_j"), F.col("ss").alias("ss_j"), "n")
    cor = (cross.join(a, ["g", "i"]).join(b, ["g", "j"])
                .withColumn("r", F.when((F.col("ss_i") > 0) & (F.col("ss_j") > 0),
                                        (F.col("n") * F.col("s") - F.col("sx_i") * F.col("sx_j"))
                                        / F.sqrt(F.col("ss_i") * F.col("ss_j"))))
                .select("g", "i", "j", "r"))
    return var.select("g", "j", "n", "var_samp"), cor


#: Columns of a correlation tile; cells (numbers) of rows that a task gathers before it multiplies, and of tiles that it holds.
TILE, BUFFER_CELLS, TILE_CELLS = 256, 4_000_000, 4_000_000


def correlated_pairs(x_rows: DataFrame, var: list, columns: dict[int, list[int]], threshold: float, tile: int = TILE,
                     buffer_cells: int = BUFFER_CELLS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(g, i, j, r) for the pairs i < j of each group's ``columns`` whose
    |correlation| exceeds ``threshold``; ``var`` are the rows of ``variances``.
    Tasks standardise blocks of rows and multiply tile by tile; what they hold
    of tiles is handed on when it exceeds ``tile_cells``.  Tiles are exchanged
    by (group, tile, tile) and added one at a time, so no task holds p^2
    numbers, and only pairs above the threshold leave.  A column ``w`` says for
    how many rows a row stands."""
    weight = ["w"] if "w" in x_rows.columns else []
    p = 1 + max([r["j"] for r in var], default=-1)
    centre, norm = {}, {}
    for r in var:
        centre.setdefault(r["g"], np.zeros(p))[r["j"]] = r["mean"]
        norm.setdefault(r["g"], np.ones(p))[r["j"]] = max((r["var_samp"] or 0.0) * (r["n"] - 1), 0.0) ** 0.5 or 1.0
    picked = {g: np.asarray(at, dtype=np.int64) for g, at in columns.items() if len(at) > 1}

    def multiply(batches):
        rows: dict[int, list] = {}
        weights: dict[int, list] = {}
        held: dict[tuple, np.ndarray] = {}

        def settle(g):
            z = (np.concatenate(rows.pop(g))[:, picked[g]] - centre[g][picked[g]]) / norm[g][picked[g]]
            of = weights.pop(g)
            if weight:
                z *= np.concatenate(of)[:, None]
            cuts = range(0, z.shape[1], tile)
            for a, lo in enumerate(cuts):
                for b, at in enumerate(cuts):
                    if b >= a:
                        part = z[:, lo:lo + tile].T @ z[:, at:at + tile]
                        held[(g, a, b)] = held[(g, a, b)] + part if (g, a, b) in held else part
                        if sum(v.size for v in held.values()) > tile_cells:
                            yield flush()

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int32()) for i in range(3)], pa.array([held[k].tobytes() for k in keys], pa.binary())],
                                             ["g", "a", "b", "part"])
            held.clear()
            return out

        for g, part in by_group(batches, ["g", *weight]):
            if g in picked:
                rows.setdefault(g, []).append(part.attrs["X"])
                weights.setdefault(g, []).append(np.sqrt(part["w"].to_numpy()) if weight else None)
                if sum(x.size for x in rows[g]) >= buffer_cells:
                    yield from settle(g)
        for g in list(rows):
            yield from settle(g)
        if held:
            yield flush()

    def add(batches):
        key, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(r["part"])
                if (r["g"], r["a"], r["b"]) == key:
                    total = total + part
                else:
                    yield above(key, total)
                    key, total = (r["g"], r["a"], r["b"]), part
        yield above(key, total)

    def above(key, total):
        if key is None:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64())], ["g", "i", "j", "r"])
        g, a, b = key
        at = picked[g]
        left, right = at[a * tile:(a + 1) * tile], at[b * tile:(b + 1) * tile]
        i, j = np.nonzero((np.abs(total) > threshold).reshape(len(left), len(right)) & (left[:, None] < right[None, :]))
        found = total.reshape(len(left), len(right))[i, j]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g, np.int32)), pa.array(left[i].astype(np.int32)), pa.array(right[j].astype(np.int32)),
                                           pa.array(found)], ["g", "i", "j", "r"])

    ship_package(x_rows.sparkSession)
    parts = x_rows.select(F.col("g").cast("int").alias("g"), "x", *weight).mapInArrow(multiply, "g int, a int, b int, part binary")
    return parts.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b").mapInArrow(add, "g int, i int, j int, r double")


def greedy_prune(order: list[int], low_var: set[int], edges: set[tuple[int, int]]) -> dict[int, str]:
    """One walk in column order: a column joins the kept set unless its
    variance is low or a column kept before it is its neighbour (|r| above the
    threshold; an undefined correlation is no edge)."""
    near: dict[int, set[int]] = {}
    for i, j in edges:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    kept: set[int] = set()
    reasons: dict[int, str] = {}
    for column in order:
        if column in low_var:
            reasons[column] = "low_variance"
        elif kept.isdisjoint(near.get(column, ())):
            kept.add(column)
        else:
            reasons[column] = "correlated"
    return reasons


#: Numeric columns up to which their products are summed by category.
SUMMED_NUMERIC = 16


def category_sums(rows: DataFrame, fitted: Fitted, flist) -> DataFrame:
    """(g, w, x, s, ss): training rows by their categories.  ``w`` counts a
    combination's rows, ``x`` are their features (numeric: means), ``s`` the sums
    of the numeric features and ``ss`` those of their products i <= j."""
    numeric, cats = [c for kind, c, _ in flist if kind == "numeric"], list(fitted.categorical)
    z = rows.join(F.broadcast(fitted.wide()), "g", "inner").select("g", *cats, *[
        F.coalesce(_num_expr(c, c in fitted.iqr_columns), F.lit(0.0)).alias(f"_z{i}") for i, c in enumerate(numeric)])
    pairs = [(i, j) for i in range(len(numeric)) for j in range(i, len(numeric))]
    combos = z.groupBy("g", *cats).agg(F.count(F.lit(1)).cast("double").alias("w"), *[F.sum(f"_z{i}").alias(f"_s{i}") for i in range(len(numeric))],
                                       *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_p{i}_{j}") for i, j in pairs])
    listed = lambda cs: F.array(*cs).cast("array<double>")
    combos = combos.select("g", *cats, "w", listed([F.col(f"_s{i}") for i in range(len(numeric))]).alias("s"), listed([F.col(f"_p{i}_{j}") for i, j in pairs]).alias("ss"),
                           F.lit(None).cast("string").alias("row_id"), *[F.lit(None).cast("double").alias(c) for c in fitted.numeric])
    made = transform_array(combos, fitted, flist, keep=["w", "s", "ss"])
    means = F.transform("s", lambda v: v / F.col("w"))
    return made.select(F.col("g").cast("int").alias("g"), "w", F.concat(means, F.slice("x", len(numeric) + 1, len(flist))).alias("x"), "s", "ss")


def _numeric_moments(sums: DataFrame, p: int) -> dict[int, tuple]:
    """{g: (rows, means, centred products)} of the ``p`` numeric features."""
    row, col = np.triu_indices(p)
    out = {}
    for r in sums.groupBy("g").agg(F.sum("w").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(p)]).alias("s"),
                                   F.array(*[F.sum(F.col("ss")[i]) for i in range(len(row))]).alias("ss")).collect():   # a row a group
        n, s, full = r["n"], np.array(r["s"]), np.zeros((p, p))
        full[row, col] = r["ss"]
        out[r["g"]] = n, s / n, full - np.outer(s, s) / n
    return out


def _feature_pairs(train_x: DataFrame, fitted: Fitted, flist, wanted, threshold: float, rows: DataFrame | None) -> tuple[list, set]:
    """Rows of ``variances``, and (g, i, j) of the correlated pairs among
    ``wanted(variances)``.  With ``rows`` (untransformed) both come from one
    aggregate by category: rows of one combination differ in numeric features
    only, whose own products are sums of that aggregate."""
    p = sum(kind == "numeric" for kind, _, _ in flist)
    if rows is None or p > SUMMED_NUMERIC:
        var = variances(train_x).collect()   # groups x features
        return var, {(r["g"], r["i"], r["j"]) for r in correlated_pairs(train_x, var, wanted(var), threshold).collect()}
    sums = materialize(category_sums(rows, fitted, flist))
    try:
        own, var, pairs = _numeric_moments(sums, p) if p else {}, [], set()
        for r in variances(sums).collect():   # groups x features
            if r["j"] < p:
                n, mean, products = own[r["g"]]
                r = {"g": r["g"], "j": r["j"], "n": n, "mean": float(mean[r["j"]]),
                     "var_samp": float(max(products[r["j"], r["j"]], 0.0) / (n - 1)) if n > 1 else None}
            var.append(r)
        columns = wanted(var)
        for g, (_, _, products) in own.items():
            norm = np.sqrt(np.maximum(np.diag(products), 0.0))
            norm[norm == 0] = 1.0
            pairs |= {(g, i, j) for i in range(p) for j in range(i + 1, p)
                      if {i, j} <= set(columns.get(g, ())) and abs(products[i, j]) / (norm[i] * norm[j]) > threshold}
        return var, pairs | {(r["g"], r["i"], r["j"]) for r in correlated_pairs(sums.select("g", "w", "x"), var, columns, threshold).collect() if r["j"] >= p}
    finally:
        sums.unpersist()


def select_features(fitted: Fitted, train_x: DataFrame, flist, variance_threshold: float = 1e-4,
                    correlation_threshold: float = 0.9, rows: DataFrame | None = None) -> DataFrame:
    """(g, gpos, pos, feature, var_samp, kept, reason) per group.  Variances
    come from sums alone, correlations from tiles of columns; the greedy pass
    runs on the driver over the pairs above the threshold.  ``rows``: the
    untransformed training rows, whose sums by category give both."""
    spark = train_x.sparkSession
    gidx = {(k, c, v): i for i, (k, c, v) in enumerate(flist)}
    cand = fitted.features.select("g", "pos", "feature", "kind", "column", "value").collect()
    var_map: dict = {}

    def wanted(var):
        # what the variance filter drops is no one's neighbour
        var_map.update({(r["g"], r["j"]): r["var_samp"] for r in var})
        return {g: [i for i in sorted(gidx[(r["kind"], r["column"], r["value"])] for r in cand if r["g"] == g)
                    if (var_map.get((g, i)) or 0.0) >= variance_threshold] for g in {r["g"] for r in cand}}

    _, pairs = _feature_pairs(train_x, fitted, flist, wanted, correlation_threshold, rows)
    by_g: dict[int, list] = {}
    for r in cand:
        by_g.setdefault(r["g"], []).append(r)
    edges: dict[int, set] = {}
    for g, i, j in pairs:
        edges.setdefault(g, set()).add((i, j))
    out = []
    for g, feats in by_g.items():
        feats.sort(key=lambda r: r["pos"])
        order = [gidx[(r["kind"], r["column"], r["value"])] for r in feats]
        low = {i for i in order if var_map.get((g, i)) is not None and var_map[(g, i)] < variance_threshold}
        dropped = greedy_prune(order, low, edges.get(g, set()))
        for r, i in zip(feats, order):
            out.append((g, i, r["pos"], r["feature"], var_map.get((g, i)), i not in dropped, dropped.get(i)))
    schema = "g int, gpos int, pos int, feature string, var_samp double, kept boolean, reason string"
    return spark.createDataFrame(out, schema)


def kept_names(selector: DataFrame) -> DataFrame:
    """(g, gpos, pos, feature, safe_name) of kept features; names sanitised
    per group in output order."""
    kept = selector.where("kept")
    w = Window.partitionBy("g").orderBy("pos")
    kept = kept.withColumn("out_pos", F.row_number().over(w) - 1)
    # sanitise within each group (names of different groups never meet)
    named = kept
    safe = F.regexp_replace(F.col("feature"), "[^A-Za-z0-9_]+", "_")
    w2 = Window.partitionBy("g", "_safe").orderBy("out_pos")
    named = (named.withColumn("_safe", safe)
                  .withColumn("_dup", F.row_number().over(w2) - 1)
                  .withColumn("safe_name", F.when(F.col("_dup") == 0, F.col("_safe"))
                              .otherwise(F.concat(F.col("_safe"), F.lit("_"), F.col("_dup").cast("string")))))
    return named.select("g", "gpos", "out_pos", "feature", "safe_name")


# --------------------------------------------------------------------------- weights
def class_weights(df: DataFrame, target: str, by: list[str] | None = None) -> DataFrame:
    """Balanced weights n / (k * n_c) per class (per group when ``by``)."""
    by = by or []
    c = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.withColumn("weight", F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class")))
