"""Counts of all grams, all learning rows."""

from riskfold.llm import toxicity


def test_seldom_grams_count(spark):
    rows = [(i, "frequent words", 0) for i in range(20)] + [(100, "frequently worded", 1), (101, "solo", 1)]
    got = {r.g: (r.t, r.o) for r in toxicity.count_grams(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()}
    want = {}
    for _, text, toxic in rows:
        for w in toxicity.tokens(text):
            for g in toxicity.grams(w):
                t, o = want.get(g, (0, 0))
                want[g] = (t + toxic, o + 1 - toxic)
    assert got == want


def test_only_the_calibration_rows_are_left_out(spark):
    docs = spark.range(2000).selectExpr("id as doc_id")
    for most, want in ((30, 30), (10_000, None)):
        aside = docs.where(toxicity.set_aside(docs, most)).count()
        assert aside == want if want else 300 < aside < 500
    copies = docs.unionByName(docs.selectExpr("doc_id % 2 as doc_id"))
    assert copies.where(toxicity.set_aside(copies, 30)).count() <= 30
