"""Per-entity aggregation and leakage checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskfold.session import materialize, settle

ID_LIKE = re.compile(r"^(id|patient_id|record_id|.*_id)$")


def entity_aggregates(events: DataFrame, entity: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """One row per entity: event count, and mean/std/min/max of each kind's
    values, in one conditional aggregation (one exchange, no join)."""
    aggs = [F.count(F.lit(1)).alias("n_events")]
    for k in kinds:
        own = F.when(F.col(kind) == F.lit(k), F.col(value))
        aggs += [F.avg(own).alias(f"{k}_mean"), F.stddev_samp(own).alias(f"{k}_std"), F.min(own).alias(f"{k}_min"),
                 F.max(own).alias(f"{k}_max")]
    return events.groupBy(entity).agg(*aggs)


def leakage_checks(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, id_like, is_target, equals_target): names that look like
    identifiers, the target itself, or a column equal to the target on every row."""
    agg = df.agg(*[F.bool_and(F.coalesce(F.col(c).try_cast("double") == F.col(target).cast("double"), F.lit(False)))
                   .alias(c) for c in features])
    lv = agg.unpivot([], features, "feature", "equals_target")
    ids = [c for c in features if ID_LIKE.match(c)]
    return lv.select("feature", F.col("feature").isin(*ids).alias("id_like") if ids else F.lit(False).alias("id_like"),
                     (F.col("feature") == F.lit(target)).alias("is_target"), "equals_target")


def split_overlap(assigned: DataFrame, content: list[str]) -> DataFrame:
    """Rows whose content appears on both sides of the split must not exceed
    the raw duplicates (identical rows may legitimately land on both sides)."""
    g = assigned.groupBy(*content).agg(F.count_if(F.col("split") == "train").alias("_tr"),
                                       F.count_if(F.col("split") == "test").alias("_te"),
                                       F.count(F.lit(1)).alias("_c"))
    agg = g.agg(F.sum(F.least("_tr", "_te")).alias("n_overlap"), F.sum(F.col("_c") - 1).alias("n_duplicates"))
    return agg.select(F.col("n_overlap").cast("long"), F.col("n_duplicates").cast("long"),
                      (F.col("n_overlap") <= F.col("n_duplicates")).alias("ok"))


def _violations(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Union of one-row aggregates into (check, n_violations, ok)."""
    out = None
    for name, one in parts:
        row = one.select(F.lit(name).alias("check"), F.col(one.columns[0]).cast("long").alias("n_violations"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("n_violations") == 0)


def validate_split(processed: DataFrame, target: str) -> DataFrame:
    """Violations of a processed long split table ``(split, row_id, target,
    feature, value)``: NULL targets, labels outside {0, 1}, features present
    in one split only, NULL feature values; zeros everywhere when clean."""
    t = F.col(target)
    # only the rows at fault are gathered by row; features and null values are counted inside the tasks
    faults = processed.where(t.isNull() | ~t.isin(0, 1)).groupBy("split", "row_id").agg(F.first(target).alias("_t"))
    seen = settle(processed.groupBy("split", "feature").agg(F.count_if(F.col("value").isNull()).alias("_null")))   # splits x features
    n_split = seen.select("split").distinct().count()    # two rows
    feats = seen.groupBy("feature").agg(F.countDistinct("split").alias("_s"))
    return _violations(
        ("null_target", faults.agg(F.count_if(F.col("_t").isNull()))),
        ("bad_label", faults.agg(F.count_if(~F.col("_t").isin(0, 1)))),
        ("feature_mismatch", feats.agg(F.count_if(F.col("_s") != n_split))),
        ("null_value", seen.agg(F.coalesce(F.sum("_null"), F.lit(0)))))


def validate_columns(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Violations of the schemas of two processed splits: a split without the
    target, columns of one split only, columns in another order, columns that
    are no numbers (row ids and fold numbers aside)."""
    sides = [[f for f in df.schema.fields if f.name not in ("row_id", "fold", "split")] for df in (train, test)]
    names = [[f.name for f in side] for side in sides]
    shared = [[n for n in side if n in names[1 - i]] for i, side in enumerate(names)]
    found = {"no_target": sum(target not in side for side in names),
             "unshared_column": len(set(names[0]) ^ set(names[1])),
             "other_order": sum(a != b for a, b in zip(*shared)),
             "not_numeric": len({f.name for side in sides for f in side if not isinstance(f.dataType, NumericType)})}
    rows = [(name, n, n == 0) for name, n in found.items()]
    return train.sparkSession.createDataFrame(rows, "check string, n_violations long, ok boolean")


def validate_folds(rows: DataFrame, manifest: DataFrame, k: int) -> DataFrame:
    """Fold manifest ``(row_id, fold)`` against the training rows: every row
    has exactly one non-null fold, no manifest row is unknown, exactly k fold
    ids, no fold leaves an empty training or validation side."""
    sides = rows.select("row_id", F.lit(1).alias("_r"), F.lit(0).alias("_m"), F.lit(0).alias("_null")).unionByName(
        manifest.select("row_id", F.lit(0).alias("_r"), F.lit(1).alias("_m"), F.col("fold").isNull().cast("int").alias("_null")))
    each = sides.groupBy("row_id").agg(F.sum("_r").alias("r"), F.sum("_m").alias("m"), F.sum("_null").alias("null"))
    r, m, null = F.col("r"), F.col("m"), F.col("null")
    # one exchange by row id; a row of both sides stands for r x m pairs, as a join of the two would give
    ids = settle(each.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(c) for c, e in (
        ("missing", F.when(F.col("row_id").isNull(), r + null).when(m == 0, r).when(r == 0, null).otherwise(r * null)),
        ("unknown", F.when((r == 0) | F.col("row_id").isNull(), m).otherwise(0)),
        ("repeated", F.when(m > 1, 1).otherwise(0)))]))
    sizes = materialize(manifest.groupBy("fold").count(), keep_cached=False)
    return _violations(
        ("missing_fold", ids.select("missing")),
        ("unknown_row", ids.select("unknown")),
        ("duplicate_row", ids.select("repeated")),
        ("fold_count_off", sizes.agg(F.abs(F.countDistinct("fold") - F.lit(k)))),
        ("empty_side", sizes.agg(F.when(F.count(F.lit(1)) < 2, 1).otherwise(0))))
