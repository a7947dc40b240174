"""Checks of folds and splits: counts on faulty input, one exchange by row id."""

from pyspark.sql import functions as F

from riskfold.operators import checks as CK


def _counts(df):
    return {r["check"]: r.n_violations for r in df.collect()}


def test_validate_folds_counts_every_fault(spark):
    rows = spark.createDataFrame([(f"r{i}",) for i in range(10)], "row_id string")
    manifest = [(f"r{i}", i % 3) for i in range(8)] + [("r0", 1), ("r1", None), ("x", 7), ("y", None), ("r9", None)]
    found = _counts(CK.validate_folds(rows, spark.createDataFrame(manifest, "row_id string, fold int"), 5))
    # r8 is missing, r9, y and one of r1's lines have no fold
    assert found == {"missing_fold": 4, "unknown_row": 2, "duplicate_row": 2, "fold_count_off": 1, "empty_side": 0}
    empty = _counts(CK.validate_folds(rows, spark.createDataFrame([], "row_id string, fold int"), 5))
    assert empty == {"missing_fold": 10, "unknown_row": 0, "duplicate_row": 0, "fold_count_off": 5, "empty_side": 1}


def test_validate_folds_reads_each_side_at_most_twice(spark):
    """Each check used to read its inputs again."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.range(100).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 5).cast("int").alias("fold"))
    counting = rows.mapInArrow(counted, rows.schema)
    found = _counts(CK.validate_folds(rows.select("row_id"), counting, 5))
    assert set(found.values()) == {0} and reads.value <= 200


def test_validate_split_counts_rows_once(spark):
    data = [("train", "a", 1, "f", 1.0), ("train", "a", 1, "h", None), ("train", "b", None, "f", 2.0), ("train", "b", None, "h", 2.0),
            ("test", "c", 3, "f", None), ("test", "d", 0, "f", 0.0)]
    found = _counts(CK.validate_split(spark.createDataFrame(data, "split string, row_id string, t int, feature string, value double"), "t"))
    assert found == {"null_target": 1, "bad_label": 1, "feature_mismatch": 1, "null_value": 2}
    plan = CK.validate_split(spark.createDataFrame(data, "split string, row_id string, t int, feature string, value double"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "IN (0,1)" in plan      # only faulty rows go to the exchange by row id
