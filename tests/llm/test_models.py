"""Toxicity and language ID: held-out accuracy, formulas, edge cases."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from riskfold.llm import langid, toxicity

NORMAL = "the cat house runs over green fields while people read books near water and old trees stand".split()
RUDE = ["blorkhead", "snarfing", "grubscum"]


def labelled(n=300, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = [rnd.choice(NORMAL) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randint(20, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(RUDE))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_finds_held_out_expressions(spark, clashing, nothing):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, toxic int")
    model = toxicity.train(df)
    fresh = labelled(100, seed=7)
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, toxic int"), model).collect()}
    assert sum(got[i] == y for i, _, y in fresh) >= 98
    out = toxicity.score(clashing, model).collect()
    assert len(out) == clashing.count() and all(0 <= r.score <= 1 and r.lang_pred == "mine" for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_joined_ratios_equal_the_broadcast_ones(spark, edges):
    df = spark.createDataFrame(labelled(80), "doc_id long, text string, toxic int")
    small = toxicity.train(df)
    docs = edges.where("length(text) < 1000 or text is null").unionByName(spark.createDataFrame(labelled(20, 3), "doc_id long, text string, n int").drop("n"), allowMissingColumns=True)
    a = toxicity.score(docs, small).select("doc_id", "score", "tox_peak").collect()
    small.small = False
    b = toxicity.score(docs, small).select("doc_id", "score", "tox_peak").collect()
    key = lambda r: (r.doc_id or -1, r.score)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x.doc_id == y.doc_id and abs(x.score - y.score) < 1e-5 and abs(x.tox_peak - y.tox_peak) < 1e-4


def test_toxicity_one_class_and_no_labels(spark, edges):
    one = toxicity.train(spark.createDataFrame([(i, "some words here", 0) for i in range(30)], "doc_id long, text string, toxic int"))
    assert all(r.score < 0.01 for r in toxicity.score(edges, one).collect())
    none = toxicity.train(spark.createDataFrame([(1, None, 1), (2, "x", None), (None, "y", 1), (3, "z", 7)], "doc_id long, text string, toxic int").where("text is not null"))
    assert all(r.predicted == 0 for r in toxicity.score(edges, none).collect())


def test_pooled_model_equals_the_recursion(spark):
    """Kneser-Ney probabilities against a direct evaluation."""
    words = {"abab": 3, "abc": 2, "ba": 1}
    counts = {}
    for w, n in words.items():
        for g in toxicity.grams(w):
            counts[g] = counts.get(g, 0) + n
    tables = {toxicity.ORDER: counts}
    for k, above in zip(toxicity.LEVELS[-2::-1], toxicity.LEVELS[:0:-1]):
        tables[k] = {}
        for g in tables[above]:
            tables[k][g[above - k:]] = tables[k].get(g[above - k:], 0) + 1

    def p(g, level):
        t = tables[toxicity.LEVELS[level]]
        alike = {x: n for x, n in t.items() if x[:-1] == g[:-1]}
        cut = len(g) - toxicity.LEVELS[level - 1]
        lower = p(g[cut:], level - 1) if level else 1 / len(alike)
        return (max(t[g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(alike) * lower) / sum(alike.values())

    got = toxicity.pooled_model(spark.createDataFrame(list(counts.items()), "g string, n long")).collect()
    assert len(got) == len(counts)
    for r in got:
        assert abs(r.p - p(r.g, len(toxicity.LEVELS) - 1)) < 1e-12


def test_toxicity_on_held_out_labels(spark, sf):
    big = sf.replace("0.001", "0.01")
    out = toxicity.op4_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.toxic[out.predicted == 1] == 1).mean() > 0.9 and out.predicted[out.toxic == 1].mean() > 0.5


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(1)
    for _ in range(150):
        k, lengths = int(rnd.integers(1, 4)), rnd.integers(0, 6, size=int(rnd.integers(1, 6)))
        scores = -rnd.random((lengths.sum(), k)).astype(np.float32) * 4
        got, at = langid.viterbi(scores, lengths, 1.5), 0
        for n in lengths:
            x, g = scores[at:at + n], got[at:at + n]
            at += n
            value = lambda p, x=x: sum(x[i, j] for i, j in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            assert not n or abs(max(map(value, itertools.product(range(k), repeat=int(n)))) - value(g)) < 1e-4


def test_language_spans_scripts_and_edges(spark, clashing, nothing):
    learn = [(t, lang) for lang, words in (("en", "the house and this thing with those words"), ("de", "und das haus mit diesen worten nicht schön"), ("ru", "это дом и слова здесь очень"))
             for t in [words] * 30]
    model = langid.train(spark.createDataFrame([*learn, (None, "en"), ("text", None)], "text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    mixed = "the house and this thing with those words und das haus mit diesen worten nicht schön это дом и слова"
    row = langid.identify(spark.createDataFrame([(mixed,)], "text string"), model).first()
    assert [mixed[s.start:s.end].split()[0] for s in row.lang_spans] == ["the", "und", "это"] and [s.lang for s in row.lang_spans] == ["en", "de", "ru"]
    out = langid.identify(clashing, model).collect()
    assert len(out) == clashing.count() and all(r.score == "mine" for r in out)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {2, 3, 4, 9} and all(0 <= r.lang_score <= 1 for r in out)
    assert {r.lang_pred for r in langid.identify(clashing, langid.train(nothing)).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0
    low = langid.identify(spark.createDataFrame([("²³ ½",), ("İİ the house and",)], "text string"), model).collect()
    assert low[0].lang_pred == "und" and low[1].lang_spans[-1].end == 16


def test_language_on_held_out_documents(spark, sf):
    out = langid.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
