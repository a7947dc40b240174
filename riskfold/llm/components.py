"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import exchanged, stash


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (u, v longs); root is the
    smallest node reachable.  Large-star and small-star steps alternate until
    every node hangs on its root: O(log^2) rounds, each written to the shared
    folder.  Minima are partial aggregates, so a node with very many links is
    not gathered anywhere."""
    edges = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(exchanged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(exchanged(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
