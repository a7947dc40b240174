"""Nested cross-validation: the configuration of every outer fold is chosen on
inner folds of its own training rows.

Outer fold o, inner fold i and the refit of o are fit groups of the same jobs:
group o * (k + 1) + i trains on the outer-train rows whose inner fold is not i,
group o * (k + 1) + k on all outer-train rows (k inner folds).  No row of outer
fold o is in any of these groups, so neither fences, medians, categories,
selectors and cuts nor models of o have seen it; it is scored once, by the
refit of the chosen configuration.

Inner folds keep at least two rows of the smaller class on every inner
validation side; where that can't be, the call fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.config import Cohort, Settings
from riskfold.functions.ranking import bucket_digits, hashed_rank
from riskfold.functions.rowid import seeded_order
from riskfold.operators import boost as B
from riskfold.operators import metrics as M
from riskfold.plans.assign import assign, dev_and_test
from riskfold.plans.experiments import Matrices, model_matrices
from riskfold.session import materialize, settle

#: The grid: depth and learning rate of depth-wise trees, and stumps as the plain alternative.
GRID = {
    "stumps": ("stumps", dict(rounds=60, rate=0.1)),
    "depth2": ("trees", dict(trees=60, rate=0.1, depth=2)),
    "depth4": ("trees", dict(trees=60, rate=0.1, depth=4)),
    "depth4_slow": ("trees", dict(trees=60, rate=0.03, depth=4)),
}


def inner_assignment(dev: DataFrame, target: str, seed: int, n_outer: int, requested: int = 3, fold: str = "fold") -> tuple[DataFrame, int]:
    """Each development row once per outer fold that it trains (``outer``),
    with its stratified ``inner_fold`` among that fold's training rows; and
    the number of inner folds."""
    outer = dev.withColumn("outer", F.explode(F.array_remove(F.array(*[F.lit(o) for o in range(n_outer)]), F.col(fold))))
    counts = sorted((r["outer"], r[target], r["n"]) for r in outer.groupBy("outer", target).agg(F.count(F.lit(1)).alias("n")).collect())   # outer folds x classes
    k = min([requested, *[n // 2 for _, _, n in counts]])
    if k < 2 or len({t for _, t, _ in counts}) < 2:
        raise ValueError("some outer fold's training rows are too few for two rows of each class in every inner fold")
    before, offset = {}, F.lit(0)
    for o, cls, n in counts:
        start = before.get(o, 0)
        offset = F.when((F.col("outer") == o) & (F.col(target) == F.lit(cls)), F.lit(start)).otherwise(offset)
        before[o] = start + n
    ranked = hashed_rank(outer.withColumn("_u", seeded_order("row_id", seed)), ["outer", target], "_u", "row_id", out="_r",
                         digits=bucket_digits(max(before.values())))
    return ranked.withColumn("inner_fold", ((offset + F.col("_r")) % F.lit(k)).cast("int")).drop("_u", "_r"), k


def nested_matrices(spark: SparkSession, dev: DataFrame, cohort: Cohort, settings: Settings, requested: int = 3) -> tuple[Matrices, int]:
    """Training and validation matrices of all (outer, inner) and refit groups."""
    inner, k = inner_assignment(dev, cohort.target, settings.seed, settings.n_folds, requested)
    inner = materialize(inner)
    place = F.col("outer") * (k + 1)
    trains = F.filter(F.sequence(F.lit(0), F.lit(k)), lambda i: i != F.col("inner_fold"))
    train = inner.withColumn("g", F.explode(F.transform(trains, lambda i: (place + i).cast("int")))).drop("outer", "inner_fold")
    validate = inner.withColumn("g", (place + F.col("inner_fold")).cast("int")).drop("outer", "inner_fold")
    refit = dev.withColumn("g", (F.col("fold") * (k + 1) + k).cast("int"))
    return model_matrices(train, validate.unionByName(refit), cohort, settings), k


def _metrics(m: Matrices, fitted: dict, grid: dict, groups, threshold: float) -> DataFrame:
    """(config, g, metrics) on the groups' validation rows."""
    out = None
    for key in fitted:
        cuts, model = fitted[key]
        rows = m.apply.where(F.col("g").isin([int(g) for g in groups(key)]))
        sc = B.score_rows(rows, cuts, model, "stumps" if grid[key][0] == "stumps" else "trees", m.blocks) \
            .select(F.lit(key).alias("config"), "g", "y", "score")
        out = sc if out is None else out.unionByName(sc)
    return M.binary_metrics(materialize(out), ["config", "g"], threshold)   # scored once


def nested_cv(spark: SparkSession, sf_dir: str, cohort: Cohort, settings: Settings = Settings(), grid: dict | None = None, requested: int = 3,
              dev: DataFrame | None = None) -> DataFrame:
    """(fold, config, n_inner, inner_<primary>, chosen, and the metrics of the
    chosen configuration's refit on the outer fold's rows)."""
    grid = GRID if grid is None else grid
    if dev is None:
        dev, _ = dev_and_test(materialize(assign(spark, sf_dir, cohort, settings)))
    m, k = nested_matrices(spark, dev, cohort, settings, requested)
    inner = [g for g in m.kept if g % (k + 1) < k]
    primary = settings.primary_metric
    searched = B.fit_many(m.train.where(F.col("g") % (k + 1) < k), m.n_features, grid, columns=m.kept, blocks=m.blocks)
    found = _metrics(m, searched, grid, lambda key: inner, settings.threshold)
    means = found.groupBy(F.floor(F.col("g") / (k + 1)).cast("int").alias("fold"), "config").agg(
        F.count(F.lit(1)).alias("n_inner"), F.avg(primary).alias(f"inner_{primary}"))
    best = Window.partitionBy("fold").orderBy(F.desc(f"inner_{primary}"), "config")
    ranked = settle(means.withColumn("chosen", F.row_number().over(best) == 1))   # outer folds x configurations
    chosen: dict[str, list[int]] = {}
    for r in ranked.where("chosen").collect():
        chosen.setdefault(r["config"], []).append(r["fold"] * (k + 1) + k)
    refits = {key: B.fit_many(m.train.where(F.col("g").isin(groups)), m.n_features, {key: grid[key]}, columns=m.kept, blocks=m.blocks)[key] for key, groups in sorted(chosen.items())}
    outer = _metrics(m, refits, grid, lambda key: chosen[key], settings.threshold)
    outer = outer.withColumn("fold", F.floor(F.col("g") / (k + 1)).cast("int")).drop("g")
    return ranked.join(outer, ["fold", "config"], "left")
