import corpus_pipeline
from pyspark.sql import functions as F

from riskfold.llm import langid, packing, simhash, toxicity
from riskfold.llm.common import stash


def test_stages_against_their_operators(spark, sf):
    """Each stage on what its predecessor kept, decisions recomputed apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    tox = corpus_pipeline.drop_toxic(spark, docs, sf)
    model = toxicity.train(toxicity.learning_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    bad = {r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).where("predicted = 1").collect()}
    ids = {r.doc_id for r in tox.collect()}
    assert tox.columns == columns and ids == {r.doc_id for r in docs.collect()} - bad
    docs = stash(tox, "t")
    lang = corpus_pipeline.drop_unknown_language(spark, docs, sf)
    assert lang.columns == columns and lang.count() >= 0.98 * docs.count()
    docs = stash(lang, "t")
    rows = docs.collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(prints)
    for n, i in enumerate(order):
        for j in order[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    once = stash(corpus_pipeline.drop_near_duplicates(spark, docs, sf), "t")
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {find(i) for i in order}
    masked = corpus_pipeline.mask_secrets(spark, once, sf)
    assert masked.columns == columns and masked.count() == once.count() and masked.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, masked, sf)
    want = packing.pieces(masked, max(packing.CAPACITIES)).agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == want


def test_stages_keep_edge_rows_and_columns(spark, clashing, nothing, sf):
    for docs in (clashing, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            kept = out.collect()
            if docs is nothing:
                assert kept == [], name
        assert corpus_pipeline.pack_sequences(spark, docs, sf).count() >= docs.count()
    ids = [r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, clashing, sf).collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids


def test_run_is_registered(spark):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    assert [langid, toxicity] and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_dedup", "secret_scan", "packing"]
