"""Spelling variants against brute force, edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskfold.llm import spelling


def brute_words(rows):
    seen = Counter()
    for name, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                seen[w] += 1
    return seen


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least=5):
    words = {w: n for w, n in counts.items() if n >= least}
    form, out = {}, {}
    for w, n in words.items():
        close = sorted([(-m, v) for v, m in words.items() if v != w and near(v, w)])
        best = close[0] if close else None
        form[w] = best[1] if best and -best[0] >= 5 * n else None
        out[w] = [form[w], None, n, len(close), words[form[w]] if form[w] else None]
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("long", [64, 7])
def test_variants_equal_brute_force(spark, long):
    rnd, words = random.Random(long), {}
    for stem in ("aaaaaa", "abcabc", "bananas", "straße", "mississippi", "àéîõüÿ"):
        words[stem] = rnd.choice([5, 3000])
        for _ in range(60):
            w = stem
            for _ in range(rnd.choice([1, 1, 2])):
                i, c = rnd.randrange(len(w)), rnd.choice("abcsé" + w)
                w = rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w + c])
            words[w] = rnd.choice([1, 4, 5, 6, 25, 26, 125, 600])
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(spelling.variants(df, long=long)) == brute(words)


def test_chains_ties_and_single_words(spark):
    counts = {"aaaaaab": 5, "aaaaaabc": 25, "aaaaaabcd": 125, "aaaaaabcde": 3125, "zzzzzz": 9, "zzzzzx": 45, "zzzzzy": 45, "lonely": 5, "rare..": 4}
    counts.pop("rare..")
    found = got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts)
    assert found["aaaaaab"][1] == "aaaaaabcde" and found["zzzzzz"][0] == "zzzzzx" and found["lonely"] == (None, "lonely", 5, 0, None)


def test_words_of_whole_texts(spark, edges, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert {r.word: r.n for r in spelling.count_words(edges).collect()} == dict(brute_words(rows))
    assert {r.word: r.n for r in spelling.count_words(clashing).collect()} == dict(brute_words(rows))
    assert spelling.variants(spelling.count_words(nothing)).count() == 0
    many = [(i, "Theirword theirwords ÀÉÎÕÜÝ x " * 3) for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == dict(brute_words(many))
    assert got(spelling.variants(spelling.count_words(df))) == brute(brute_words(many))


def test_a_word_of_many_letters(spark):
    long = "abcdefghij" * 2_000
    counts = {long: 5, long[:700] + long[701:]: 60, long[:9] + "é" + long[10:]: 6, "x" * 65: 5, "x" * 64: 40, "x" * 63: 7}
    found = got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts)


def test_runs_are_linear_in_their_members():
    import numpy as np
    import pyarrow as pa
    n = 90
    ids, near_count, best = spelling.scan(pa.array(["k"] * (n + 1)), np.array([0] + [1] * n), np.array([500, *range(n)]), np.array([False] + [True] * n))
    assert len(ids) == n + 1 and set(near_count) == {n} and best[list(ids).index(0)] == 1 and best[list(ids).index(5)] == 0
