"""Stratified hold-out split, stratified k folds, fold reports, fold expansion.

Row order inside a class is the seeded md5 order of ``row_id`` (ties by
``row_id``); the rank is computed with ``hashed_rank`` so no class ever sits in
one task.  Quotas come from the class-count table (a handful of rows).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.ranking import bucket_digits, hashed_rank
from riskfold.functions.rowid import seeded_order


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class"))


def test_quotas(df: DataFrame, target: str, test_size: float) -> DataFrame:
    """(target, n_class, n_test_class): n_test = ceil(n * test_size); each
    class gets floor(n_test * n_c / n), the remaining rows go to the largest
    remainders (ties: smaller class label first)."""
    return _quotas(class_counts(df, target), target, test_size)


def _quotas(c: DataFrame, target: str, test_size: float) -> DataFrame:
    everything = Window.partitionBy(F.lit(1))
    c = (c.withColumn("_n", F.sum("n_class").over(everything))
          .withColumn("_n_test", F.ceil(F.col("_n") * F.lit(float(test_size))).cast("long"))
          .withColumn("_base", F.expr("(_n_test * n_class) div _n").cast("long"))
          .withColumn("_rem", (F.col("_n_test") * F.col("n_class")) % F.col("_n"))
          .withColumn("_short", F.col("_n_test") - F.sum("_base").over(everything))
          .withColumn("_order", F.row_number().over(Window.partitionBy(F.lit(1))
                                                     .orderBy(F.desc("_rem"), F.asc(target)))))
    return c.select(target, "n_class",
                    (F.col("_base") + F.when(F.col("_order") <= F.col("_short"), 1).otherwise(0))
                    .cast("long").alias("n_test_class"))


def _check_split(counts: list, test_size: float) -> None:
    import math
    n = sum(r["n_class"] for r in counts)
    if n == 0:
        raise ValueError("cannot split an empty frame")
    if min(r["n_class"] for r in counts) < 2:
        raise ValueError("the least populated class has fewer than 2 rows")
    n_test = math.ceil(n * test_size)
    if n_test < len(counts) or n - n_test < len(counts):
        raise ValueError("test and train sizes must each be at least the number of classes")


def _by_class(target: str, values: dict) -> Column:
    """A constant per class (a case per class, no join)."""
    out = F.lit(None).cast("long")
    for cls, v in values.items():
        out = F.when(F.col(target) == F.lit(cls), F.lit(v).cast("long")).otherwise(out)
    return out


def _quota_split(ranked: DataFrame, target: str, counts: list) -> DataFrame:
    quota = _by_class(target, {r[target]: r["n_test_class"] for r in counts})
    split = F.when(F.col("_r") < quota, "test").otherwise("train")
    return ranked.withColumn("_quota", quota).withColumn("split", split)


def stratified_split(df: DataFrame, target: str, seed: int, test_size: float,
                     validate: bool = True) -> DataFrame:
    """Add ``split`` in {'train','test'}: exhaustive, disjoint, per-class
    exact quotas, seeded."""
    counts = test_quotas(df, target, test_size).collect()   # a row per class
    if validate:
        _check_split(counts, test_size)
    ranked = hashed_rank(df, [target], seeded_order("row_id", seed), "row_id", out="_r", digits=bucket_digits(sum(r["n_class"] for r in counts)))
    return _quota_split(ranked, target, counts).drop("_r", "_quota")


def split_and_folds(df: DataFrame, target: str, seed: int, test_size: float, k: int) -> DataFrame:
    """``split`` and, for the train rows, ``fold``, from one rank: split and
    shuffled folds order a class by the same seeded hash, so a train row's
    place among the train rows is its rank less the class's test quota."""
    return next(split_and_folds_of([df], target, seed, test_size, k))


def hash_part(seed: int, parts: int) -> Column:
    """Which of ``parts`` (at most 256) runs of the seeded order a row is in."""
    return F.floor(F.conv(F.substring(seeded_order("row_id", seed), 1, 2), 16, 10).cast("int") * parts / 256).cast("int")


def split_and_folds_of(parts: list[DataFrame], target: str, seed: int, test_size: float, k: int) -> Iterator[DataFrame]:
    """``split_and_folds`` of the union of ``parts``, each a run of the seeded
    order (``hash_part``), in order: a rank counts from the class's rows in the
    parts before, so only one part at a time has to be exchanged."""
    sizes = [{r[target]: r["n_class"] for r in class_counts(p, target).collect()} for p in parts]   # a row per class
    total: dict = {}
    for own in sizes:
        for cls, n in own.items():
            total[cls] = total.get(cls, 0) + n
    kind = parts[0].schema[target].dataType.simpleString()
    each = parts[0].sparkSession.createDataFrame(sorted(total.items()), f"`{target}` {kind}, n_class long")
    counts = _quotas(each, target, test_size).collect()   # a row per class
    _check_split(counts, test_size)
    train = sorted((r[target], r["n_class"] - r["n_test_class"]) for r in counts)
    _check_folds([n for _, n in train], k)
    offsets, acc = {}, 0
    for cls, n in train:
        offsets[cls] = acc
        acc += n
    before = {cls: 0 for cls in total}
    for part, own in zip(parts, sizes):
        ranked = hashed_rank(part, [target], seeded_order("row_id", seed), "row_id", out="_r", digits=bucket_digits(sum(own.values())))
        ranked = _quota_split(ranked.withColumn("_r", F.col("_r") + _by_class(target, before)), target, counts)
        fold = ((_by_class(target, offsets) + F.col("_r") - F.col("_quota")) % F.lit(k)).cast("int")
        yield ranked.withColumn("fold", F.when(F.col("split") == "train", fold)).drop("_r", "_quota")
        before = {cls: n + own.get(cls, 0) for cls, n in before.items()}


def _check_folds(sizes: list[int], k: int) -> None:
    n = sum(sizes)
    if n == 0:
        raise ValueError("cannot fold an empty frame")
    if k < 2:
        raise ValueError("k must be at least 2")
    if n < k:
        raise ValueError(f"cannot make {k} folds of {n} rows")
    if all(c < k for c in sizes):
        raise ValueError(f"every class has fewer than {k} rows")


def _fold_blocks(counts: list[tuple], k: int) -> dict:
    """Unshuffled variant: per class, rank r goes to fold f while
    r < cum_f; cum from the round-robin allocation of the class-sorted
    sequence (class offset o_c, size n_c)."""
    blocks, offset = {}, 0
    for cls, n in counts:
        cum, bounds = 0, []
        for f in range(k):
            a, b = offset - f, offset + n - f
            cnt = (b + k - 1) // k - (a + k - 1) // k
            cum += cnt
            bounds.append(cum)
        blocks[cls] = bounds
        offset += n
    return blocks


def stratified_folds(df: DataFrame, target: str, k: int, seed: int, shuffle: bool = True,
                     out: str = "fold") -> DataFrame:
    """Add ``out`` in 0..k-1.  Classes ascending; with shuffle the class's
    rows in seeded md5 order take folds (class_offset + r) mod k (the
    allocation of a stratified k-fold); without shuffle the same per-fold
    counts are taken as contiguous blocks in row_id order."""
    counts = sorted((r[0], r[1]) for r in class_counts(df, target).collect())  # a row per class
    n = sum(c for _, c in counts)
    _check_folds([c for _, c in counts], k)
    offsets, acc = {}, 0
    for cls, c in counts:
        offsets[cls] = acc
        acc += c
    offset_col = F.lit(0).cast("long")
    for cls, off in offsets.items():
        offset_col = F.when(F.col(target) == F.lit(cls), F.lit(off).cast("long")).otherwise(offset_col)
    order = seeded_order("row_id", seed) if shuffle else F.col("row_id")
    ranked = hashed_rank(df.withColumn("_u", order), [target], "_u", "row_id", out="_r", digits=bucket_digits(n))
    if shuffle:
        fold = ((offset_col + F.col("_r")) % F.lit(k)).cast("int")
    else:
        fold = F.lit(None).cast("int")
        for cls, bounds in _fold_blocks(counts, k).items():
            per_class = F.lit(k - 1)
            for f in range(k - 2, -1, -1):
                per_class = F.when(F.col("_r") < F.lit(bounds[f]), F.lit(f)).otherwise(per_class)
            fold = F.when(F.col(target) == F.lit(cls), per_class).otherwise(fold)
        fold = fold.cast("int")
    return ranked.withColumn(out, fold).drop("_u", "_r")


def inner_fold_count(df: DataFrame, target: str, requested: int = 3) -> int:
    """Inner folds must leave >= 2 minority rows in each validation fold:
    k = min(requested, floor(minority / 2)); infeasible (< 2) raises."""
    minority = min(r["n_class"] for r in class_counts(df, target).collect())
    k = min(requested, minority // 2)
    if k < 2:
        raise ValueError(f"minority class has {minority} rows: cannot keep 2 per validation fold")
    return k


def inner_folds(df: DataFrame, target: str, seed: int, requested: int = 3) -> DataFrame:
    return stratified_folds(df, target, inner_fold_count(df, target, requested), seed, out="inner_fold")


def fold_report(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """(fold, n_train, n_validation, train_positive_rate,
    validation_positive_rate): one group-by over the folds, totals by
    subtraction on the k-row result."""
    per = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_validation"),
                              F.sum(F.col(target)).cast("long").alias("_pos"))
    allw = Window.partitionBy(F.lit(1))
    return (per.withColumn("_n", F.sum("n_validation").over(allw))
               .withColumn("_p", F.sum("_pos").over(allw))
               .select(F.col(fold).alias("fold"),
                       (F.col("_n") - F.col("n_validation")).alias("n_train"),
                       "n_validation",
                       ((F.col("_p") - F.col("_pos")) / (F.col("_n") - F.col("n_validation")))
                       .alias("train_positive_rate"),
                       (F.col("_pos") / F.col("n_validation")).alias("validation_positive_rate")))


def fit_groups(k: int, include_full: bool = True) -> list[int]:
    """Fit group ids: -1 = all development rows (hold-out refit), 0..k-1 = folds."""
    return ([-1] if include_full else []) + list(range(k))


def fold_fits(k: int, fold: str = "fold") -> tuple[str, list[int]]:
    """(fold column, fit groups), for statistics as all folds less one."""
    return fold, fit_groups(k)


def train_view(dev: DataFrame, k: int, include_full: bool = True, fold: str = "fold") -> DataFrame:
    """Each development row once per fit group it trains: g != own fold.
    A generator, no join; used inside aggregations it is combined map-side,
    so the exchange carries statistics, not k copies of the rows."""
    groups = F.array(*[F.lit(g) for g in fit_groups(k, include_full)])
    return dev.withColumn("g", F.explode(F.array_remove(groups, F.col(fold))))


def apply_view(dev: DataFrame, test: DataFrame | None = None, fold: str = "fold") -> DataFrame:
    """Rows scored by each fit group: a fold's validation rows (g = fold),
    and the hold-out rows for the full refit (g = -1)."""
    out = dev.withColumn("g", F.col(fold))
    if test is not None:
        out = out.unionByName(test.withColumn("g", F.lit(-1)), allowMissingColumns=True)
    return out


def fold_expand(dev: DataFrame, k: int, include_full: bool = True, fold: str = "fold") -> DataFrame:
    """All (g, row, role) pairs of the development rows: role 'train' for
    g != fold, 'validation' for g = fold."""
    tr = train_view(dev, k, include_full, fold).withColumn("role", F.lit("train"))
    va = dev.withColumn("g", F.col(fold)).withColumn("role", F.lit("validation"))
    return tr.unionByName(va)


def bounded_sample(df: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per group, chosen by the seeded md5 order of
    ``row_id`` (deterministic, retry-safe); a group with at most n rows is
    returned whole.  The limit is the operator.  Ranks come from
    ``hashed_rank`` so a large group is never ranked in one task, and rows that
    lie behind a group's n-th are not exchanged."""
    if n <= 0:
        raise ValueError(f"a sample of {n} rows was asked for")
    counts = df.groupBy(*by).count().agg(F.sum("count")).first()[0] or 0
    key, digits = seeded_order("row_id", seed), bucket_digits(counts)
    # only buckets up to the one that holds a group's n-th row are ranked
    own = df.withColumn("_b", F.substring(key, 1, digits))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = own.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    last = sizes.where(F.col("_before") < n).groupBy(*by).agg(F.max("_b").alias("_last"))
    near = own.join(F.broadcast(last), by).where(F.col("_b") <= F.col("_last")).select(*df.columns)
    return hashed_rank(near, by, key, "row_id", out="_r", digits=digits).where(F.col("_r") < n).select(*df.columns)
