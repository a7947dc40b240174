from pyspark.sql import functions as F

from riskfold.llm import packing


def test_bins_are_opened_only_as_long_as_their_fillers_last():
    made = packing.plan({600: 10_000, 424: 1})
    assert sum(n * packing.cost(c) for _, n, c, _ in made.bins) < 8.6e6  # 11.5e6 with every bin at 1024
    assert sum(n * used for _, n, _, used in made.bins) == 600 * 10_000 + 424


def test_lengths_from_a_column(clashing):
    docs = clashing.withColumn("tokens", F.length("text") + 1)
    out = packing.pack(docs, (16, 64, 256), length=F.col("tokens"))
    assert out.agg(F.sum("length")).first()[0] == docs.agg(F.sum(F.coalesce("tokens", F.lit(1)))).first()[0]
    assert out.where("offset + length > capacity").count() == 0
