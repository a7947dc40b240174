"""Rows as many as the input stay out of the executors' memory, and exchanges
hold a part of them at a time; the results are those of the whole table."""

import os

from pyspark.sql import functions as F

from riskfold.config import Settings
from riskfold.operators import split as S
from riskfold.plans.assign import assign
from riskfold.session import shuffles_removed

SF = "/root/testdata/sf0.001"


def test_assignment_in_parts_is_that_of_the_whole(spark):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    whole = assign(spark, SF, "lines", Settings(), parts=1)
    parts = assign(spark, SF, "lines", Settings(), parts=3)
    assert parts.count() == whole.count() > 0
    assert parts.exceptAll(whole.select(*parts.columns)).isEmpty()
    narrow = assign(spark, SF, "lines", Settings(), ["l_tax"], parts=2)
    assert narrow.exceptAll(whole.select(*narrow.columns)).isEmpty() and narrow.count() == whole.count()
    # neither is anything cached, nor does a cleaned part stay once it is ranked
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    left = [f for d, _, names in os.walk(shared) if "/clean-" in d for f in names if f.startswith("part-")]
    assert not left


def test_ranks_go_on_from_part_to_part(spark):
    rows = spark.range(700).select(F.md5(F.col("id").cast("string")).alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    whole = S.split_and_folds(rows, "y", 42, 0.2, 5)
    own = rows.withColumn("part", S.hash_part(42, 4))
    assert own.select("part").distinct().count() == 4
    each = list(S.split_and_folds_of([own.where(F.col("part") == i).drop("part") for i in range(4)], "y", 42, 0.2, 5))
    found = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    key = lambda df: sorted((r.row_id, r.split, -1 if r.fold is None else r.fold) for r in df.collect())
    assert key(found) == key(whole)


def test_sample_ranks_only_rows_before_the_cut(spark, monkeypatch):
    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"))
    seen, rank = [], S.hashed_rank
    monkeypatch.setattr(S, "hashed_rank", lambda df, *a, **k: (seen.append(df.count()), rank(df, *a, **k))[1])
    found = S.bounded_sample(rows, ["fold"], 25, 7)
    order = sorted((r.fold, r.h, r.row_id) for r in rows.withColumn("h", S.seeded_order("row_id", 7)).collect())
    want = sorted(x[2] for f in range(3) for x in [o for o in order if o[0] == f][:25])
    assert sorted(r.row_id for r in found.collect()) == want
    assert seen[0] < 2_000    # all 20,000 went through the exchange before
    assert S.bounded_sample(rows.limit(30), ["fold"], 100, 7).count() == 30


def test_sinks_are_joined_by_parts(spark, tmp_path):
    """All wide rows used to go through one exchange whose files stayed, beside the assigned rows."""
    from riskfold.plans.process import Processed, read_back, write_outputs
    held, folder = str(tmp_path / "assigned"), str(tmp_path / "sinks")
    rows = spark.range(200).select(F.when(F.col("id") < 40, "test").otherwise("train").alias("split"), F.when(F.col("id") >= 40, (F.col("id") % 5).cast("int")).alias("fold"),
                                   F.md5(F.col("id").cast("string")).alias("row_id"), (F.col("id") % 2).cast("int").alias("returned"),
                                   F.array(F.col("id") / 7, (F.col("id") % 3 == 0).cast("double")).alias("x"))
    rows.write.parquet(held)
    done = Processed(spark.read.parquet(held), [(0, 0, "a"), (1, 1, "b_c")], "returned", 1, held)
    write_outputs(done, folder)
    assert os.path.isdir(held)
    found = read_back(spark, done, folder, parts=3)
    assert not os.path.isdir(held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    one = found.where("out_pos = 0").select("row_id", "fold", "split", F.col("value").alias("v"))
    name = next(n for _, pos, n in done.kept if pos == 0)
    rows = spark.read.parquet(f"{folder}/processed").join(spark.read.parquet(f"{folder}/folds"), "row_id", "left")
    want = rows.select("row_id", "fold", "split", F.col(f"`{name}`").alias("v"))
    assert one.exceptAll(want).isEmpty() and one.count() == want.count() and found.count() == want.count() * len(done.kept)


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
