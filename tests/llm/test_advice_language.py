"""Scripts rule languages out; clean mixed texts stay; one labelling path."""

import corpus_pipeline
from riskfold.llm import langid

LEARN = [("en", "the house and this thing with those words"), ("de", "und das haus mit diesen worten nicht schön"), ("ru", "это дом и слова здесь очень")]


def test_a_script_rules_languages_out_and_both_forms_agree(spark):
    model = langid.train(spark.createDataFrame([(t, k) for k, t in LEARN for _ in range(30)], "text string, lang string"))
    texts = ["the house дом", "the house and дом this thing", "İİ the house and дом", "²³ the ½", "x" * 85, "", "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    full = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [s.lang for s in full[0].lang_spans] == ["en", "ru"] and [s.lang for s in full[1].lang_spans] == ["en", "ru", "en"]
    assert [texts[1][s.start:s.end] for s in full[1].lang_spans] == ["the house and", "дом", "this thing"]
    assert [(s.start, s.end) for s in full[4].lang_spans] == [(0, 85)]
    for r in langid.identify(docs, model, spans=False).collect():
        assert (r.lang_pred, r.lang_score) == (full[r.doc_id].lang_pred, full[r.doc_id].lang_score)


def test_a_clean_text_of_three_languages_stays(spark):
    part = dict(LEARN)
    mixed = " ".join([part["en"], part["en"][:12], part["de"], part["ru"], part["ru"][:6]])
    rows = [(i, part[k], k) for i in range(60) for k in part] + [(1000, mixed, "en"), (1001, "!!! 123", "en"), (1002, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert langid.identify(docs.where("doc_id = 1000"), model).first().lang_score < 0.5
    ids = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()}
    assert 1000 in ids and not ids & {1001, 1002} and set(range(60)) <= ids
