"""Class ratios, word sums, features and link against a direct evaluation."""

import math
import random

import numpy as np
import pytest

from riskfold.llm import toxicity as tox


def direct(counts):
    """(ratio of any gram, discounts) by the formulas of modified Kneser-Ney."""
    cut = {c: tox.discounts(*[sum(n[i] == k for n in counts.values()) for k in (1, 2, 3, 4)]) for i, c in enumerate("to")}
    tables = {tox.ORDER: {g: t + o for g, (t, o) in counts.items()}}
    for k, above in zip(tox.LEVELS[-2::-1], tox.LEVELS[:0:-1]):
        tables[k] = {}
        for g in tables[above]:
            tables[k][g[above - k:]] = tables[k].get(g[above - k:], 0) + 1

    def pooled(g, level):
        table = tables[tox.LEVELS[level]]
        alike = {x: n for x, n in table.items() if x[:-1] == g[:-1]}
        lower = pooled(g[len(g) - tox.LEVELS[level - 1]:], level - 1) if level else 1 / len(alike)
        return (max(table[g] - tox.DISCOUNT, 0) + tox.DISCOUNT * len(alike) * lower) / sum(alike.values())

    def off(n, d):
        return d[min(n, 3) - 1] if n else 0.0

    def ratio(g):
        alike = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        p, logs = pooled(g, len(tox.LEVELS) - 1) if g in counts else None, []
        for i, c in enumerate("to"):
            total, free = sum(n[i] for n in alike.values()), sum(off(n[i], cut[c]) for n in alike.values())
            own = counts.get(g, (0, 0))[i]
            if not total:
                logs.append(math.log(p) if p else 0.0)
            elif p:
                logs.append(math.log((own - off(own, cut[c]) + free * p) / total))
            else:
                logs.append(math.log(free / total))   # the shared probability cancels
        return logs[0] - logs[1]

    return ratio, cut


def learning(seed=2, n=150):
    rnd, out = random.Random(seed), []
    for i in range(n):
        toxic = i % 3 == 0
        words = rnd.choices(["abab", "abcab", "bacab", "cabba", "abbbc", "straße"] + (["badab", "badbad", "xa"] if toxic else ["xa"] * 3), k=6)
        out.append((i, " ".join(words), int(toxic)))
    return out + [(n, "solo xad", 1), (n + 1, "soloist", 0)]


def test_ratios_of_seen_and_unseen_grams(spark):
    rows = learning()
    counts = {}
    for _, text, toxic in rows:
        for w in tox.tokens(text):
            for g in tox.grams(w):
                t, o = counts.get(g, (0, 0))
                counts[g] = (t + toxic, o + 1 - toxic)
    ratio, _ = direct(counts)
    table = {r.g: r.r for r in tox.ratio_table(tox.count_grams(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))).collect()}
    assert set(table) == set(counts) | {g[:-1] for g in counts}
    assert all(abs(table[g] - ratio(g)) < 1e-9 for g in counts)
    for h in {g[:-1] for g in counts}:
        assert abs(table[h] - ratio(h + "~")) < 1e-9
    words = ["abab", "xac", "badly", "solos", "unheard", "zzz", "é"]
    want = {w: sum(ratio(g) for g in tox.grams(w)) for w in words}
    found = spark.createDataFrame(list(table.items()), "g string, r double")
    joined = {r.w: r.r for r in tox.word_ratios(spark.createDataFrame([(w,) for w in words], "w string"), found).collect()}
    packed = tox._opened(tox._pack(found))
    direct_sums = packed.rows([words, [], words[:2]])
    assert all(abs(joined[w] - want[w]) < 1e-9 and abs(direct_sums[0][i] - want[w]) < 1e-5 for i, w in enumerate(words))
    assert len(direct_sums[1]) == 0


def test_an_unseen_letter_after_a_known_history(spark):
    """Toxic xa x 10, ordinary xb x 1000 and xa once: the second letter of xc."""
    counts = spark.createDataFrame([("^" * 7 + "xa", 10, 1), ("^" * 7 + "xb", 0, 1000)], "g string, t long, o long")
    cut = tox.class_discounts(counts)
    free = {"t": cut["t"][2], "o": cut["o"][0] + cut["o"][2]}
    got = {r.g: r.r for r in tox.ratio_table(counts).collect()}
    assert abs(got["^" * 7 + "x"] - (math.log(free["t"] / 10) - math.log(free["o"] / 1001))) < 1e-12


def test_discounts_from_the_counts_of_counts():
    assert tox.discounts(0, 5, 1, 1) == (tox.DISCOUNT,) * 3
    d = tox.discounts(1000, 400, 200, 120)
    y = 1000 / 1800
    assert np.allclose(d, (1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6))
    for ns in ((5, 100, 100, 100), (1, 1, 0, 0), (10**6, 1, 1, 1)):
        d = tox.discounts(*ns)
        assert 0 < d[0] < 1 and 0 < d[1] < 2 and 0 < d[2] < 3


def test_estimated_discounts_explain_held_out_words_better_than_a_fixed_three_and_a_half(spark, monkeypatch):
    """Log-likelihood of each class's held-out words under its own model."""
    rows, fresh = learning(1, 300), learning(9, 120)
    counts = {}
    for _, text, toxic in rows:
        for w in tox.tokens(text):
            for g in tox.grams(w):
                t, o = counts.get(g, (0, 0))
                counts[g] = (t + toxic, o + 1 - toxic)
    pooled = {r.g: r.p for r in tox.pooled_model(spark.createDataFrame([(g, t + o) for g, (t, o) in counts.items()], "g string, n long")).collect()}

    def likelihood(cut):
        total = 0.0
        for _, text, toxic in fresh:
            i = 1 - toxic
            for w in tox.tokens(text):
                for g in tox.grams(w):
                    alike = [n[i] for x, n in counts.items() if x[:-1] == g[:-1]]
                    if g in counts and sum(alike):
                        off = lambda n: min(n, cut[i][min(n, 3) - 1]) if n else 0.0
                        total += math.log((counts[g][i] - off(counts[g][i]) + sum(map(off, alike)) * pooled[g]) / sum(alike))
        return total

    estimated = [tox.discounts(*[sum(n[i] == k for n in counts.values()) for k in (1, 2, 3, 4)]) for i in (0, 1)]
    assert likelihood(estimated) > likelihood([(3.5,) * 3] * 2)


def test_features_written_out():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 6, 200):
        r = rnd.normal(0, 3, n)
        over = math.log1p(sum(max(x - tox.MARGIN, 0) for x in r))
        top = sum(max(x, 0) for x in sorted(r)[-tox.STRONGEST:]) / tox.STRONGEST
        assert np.allclose(tox.features(r), (r.mean(), over, top, math.log1p(n)))
    assert tox.features(np.zeros(0)) == (0.0,) * 4


@pytest.mark.parametrize("small", [True, False])
def test_clashing_names_on_both_sides_of_the_switch(spark, clashing, small):
    model = tox.train(spark.createDataFrame(learning(), "doc_id long, text string, toxic int"), broadcast_grams=10**6 if small else 0)
    assert model.small == small
    more = clashing.selectExpr("*", "'mine' as k", "'mine' as n", "'mine' as w", "'mine' as r", "'mine' as rs", "'mine' as words")
    got = tox.score(more, model).collect()
    assert len(got) == clashing.count() and all(r.words == r.k == r.rs == r.row == "mine" and 0 <= r.score <= 1 for r in got)
