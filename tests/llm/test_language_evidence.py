"""Absolute evidence of a learned language: precision and recall, both sides."""

import random

import numpy as np
from pyspark.sql import functions as F

from riskfold.llm import langid

_made = random.Random(9)
EN = sorted({"".join(_made.choice("bcdfghlmnprstw") + _made.choice("aeiou") for _ in range(_made.randint(2, 4))) for _ in range(1500)})
DE = sorted({"".join(_made.choice("bcdfghklmnprstvwz") + _made.choice("äöüyßj") for _ in range(_made.randint(2, 5))) for _ in range(3000)})
JA, RU = "日本語の文章はここにあります 東京は大きい都市です".split(), "привет как дела сегодня хорошая погода".split()


def learnt(spark):
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choices(EN if i % 2 else DE, k=60)), "en" if i % 2 else "de") for i in range(200)]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_learned_languages_stay_and_others_go(spark):
    rnd, rows = random.Random(2), []
    for i in range(120):
        k = rnd.randint(1, 40)
        rows.append((i, " ".join(rnd.choices(EN, k=k)), 1))
        rows.append((i, " ".join(rnd.choices(DE, k=k)), 1))
        rows.append((i, " ".join(rnd.choices(EN, k=14) + rnd.choices(DE, k=14) + ["Xqz", "IBM", "7", "東京"]), 1))   # mixed, with names
        rows.append((i, " ".join(rnd.choices(JA, k=k)), 0))
        rows.append((i, " ".join(rnd.choices(RU, k=k)), 0))
        rows.append((i, " ".join("".join(rnd.choices("qxzjvwkpf", k=rnd.randint(3, 8))) for _ in range(k + 1)), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = langid.identify(df, learnt(spark), spans=False).select("y", (F.col("lang_evidence") >= langid.LEAST_EVIDENCE).alias("kept")).collect()
    kept = [r.y for r in got if r.kept]
    assert sum(kept) / len(kept) > 0.99                                  # precision of what stays
    assert sum(kept) / sum(r.y for r in got) > 0.99                      # recall of clean texts


def test_evidence_is_the_mean_in_standard_deviations(spark):
    model = learnt(spark)
    text = " ".join(EN[:3] + DE[:3])
    spans = next(langid.label([text], langid.Scores(model)))
    fits, grams = 0.0, 0
    for s, e, k, _ in spans[0]:
        for w in text[s:e].split():
            at = langid.slots(w)
            fits += (float(model.logs[at, k].sum()) - len(at) * model.mean[k]) / model.spread[k]
            grams += len(at)
    assert abs(spans[1] - fits / grams) < 1e-4
    assert abs(next(langid.label(["привет"], langid.Scores(model)))[1] + langid.FOREIGN) < 1e-6
    assert next(langid.label(["12 !"], langid.Scores(model))) == ([], 0.0)


def test_means_follow_from_the_learning_counts(spark):
    model = learnt(spark)
    rnd, own = random.Random(1), {"en": [], "de": []}
    for i in range(200):
        words, lang = rnd.choices(EN if i % 2 else DE, k=60), "en" if i % 2 else "de"
        own[lang] += [float(model.logs[s, model.langs.index(lang)]) for w in words for s in langid.slots(w)]
    for k, lang in enumerate(model.langs):   # no deviation is taken as smaller than a half
        assert abs(model.mean[k] - np.mean(own[lang])) < 1e-4 and abs(model.spread[k] - max(0.5, np.std(own[lang]))) < 1e-4


def test_a_hardly_known_language_rejects_nothing_in_its_script(spark):
    model = langid.train(spark.createDataFrame([("one text of few words " * 50, "en")], "text string, lang string"))
    df = spark.createDataFrame([(1, "quite other phrases here"), (2, "привет как дела")], "doc_id long, text string")
    got = {r.doc_id: r.lang_evidence for r in langid.identify(df, model, spans=False).collect()}
    assert got[1] == 0.0 and got[2] == -langid.FOREIGN


def test_plain_words_equal_the_general_cut():
    rnd = random.Random(5)
    for _ in range(2000):
        text = "".join(rnd.choices("abéßöāɏªµº12²½_ ,\n'×÷ж東", k=12)).lower()
        general = [w for w in langid._WORD.findall(text) if w[0].isalpha() or any(map(str.isalpha, w))]
        if not langid._BEYOND.search(text) and not set(text) & set("²½"):
            assert langid._PLAIN_WORD.findall(text) == general
