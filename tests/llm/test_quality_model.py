"""Quality classifier: moments, densities, held-out accuracy, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from riskfold.llm import quality_model as qm

WORDS = "the of and house river stone letter morning people walked slowly towards green hills while others stayed behind".split()


def rows(n, seed):
    rnd, out = random.Random(seed), []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(60, 300))]
        good = i % 3 > 0
        text = ". ".join(" ".join(words[j:j + 9]).capitalize() for j in range(0, len(words), 9))
        if not good:
            text = [text.upper() + "!!", " ".join(w + rnd.choice("#*%&") for w in words), " ".join([words[0]] * len(words))][i // 3 % 3]
        out.append((i, text, int(good)))
    return out


def learnt(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_held_out_texts(spark):
    docs, labels = learnt(spark, rows(600, 1))
    fresh = rows(300, 2)
    both = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t, _ in fresh], "doc_id long, text string"))
    got = {r.doc_id: r.predicted for r in qm.classify(both, labels).collect()}
    assert sum(got[10_000 + i] == y for i, _, y in fresh) >= 297


def test_moments_are_exact_on_any_partitioning(spark):
    data = rows(90, 5)
    docs, labels = learnt(spark, data)
    rows_ = qm.with_statistics(docs).join(labels, "doc_id")
    x = np.array([[round(v * qm.UNIT) for v in qm.statistics(t)] for _, t, _ in data])
    y = np.array([k for *_, k in data])
    for parts in (1, 7):
        found = qm.moments(rows_.repartition(parts))
        for k in (0, 1):
            n, s, q = found[k]
            assert n == (y == k).sum()
            assert (s == x[y == k].sum(0) / qm.UNIT).all()
            assert np.array_equal(q, (x[y == k].T @ x[y == k]) / qm.UNIT / qm.UNIT)


def test_scores_equal_the_densities_written_out(spark):
    rnd = np.random.default_rng(3)
    p = len(qm.STATISTICS)
    mix = rnd.normal(size=(p, p))
    x = {0: rnd.normal(size=(400, p)) @ mix, 1: rnd.normal(size=(900, p)) * 0.5 + 0.3}
    model = qm.fit({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()})
    every = np.vstack([x[0], x[1]])
    centre, scale = every.mean(0), every.std(0)
    cov = {k: np.cov(v.T, bias=True) / np.outer(scale, scale) for k, v in x.items()}
    within = (400 * cov[0] + 900 * cov[1]) / 1300
    at = rnd.normal(size=(5, p))
    logs = {}
    for k in (0, 1):
        s = (1 - qm.POOLED) * cov[k] + qm.POOLED * within
        s = (1 - qm.ROUND) * s + qm.ROUND * (np.trace(s) / p + 1e-6) * np.eye(p)
        d = (at - x[k].mean(0)) / scale
        logs[k] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1]
    want = 1 / (1 + np.exp(-((logs[1] - logs[0]) / qm.TEMPERATURE + np.log(900 / 400))))
    assert np.allclose(model.scores(at * qm.UNIT), want, atol=1e-9)


def test_one_class_no_labels_and_edges(spark, edges, clashing, nothing):
    one = spark.createDataFrame([(1, 1), (6, 1), (None, 0), (5, 7), (99, 0)], "doc_id long, quality int")
    assert {r.score for r in qm.classify(edges, one).collect()} == {1.0}
    assert {r.score for r in qm.classify(edges, one.limit(0)).collect()} == {0.0}
    two = spark.createDataFrame([(1, 1), (6, 1), (13, 0), (3, 0), (3, 0)], "doc_id long, quality int")
    a, b = qm.classify(edges, two).collect(), qm.classify(clashing, two).collect()
    assert len(a) == edges.count() and all(0 <= r.score <= 1 for r in a)
    assert sorted(r.score for r in a) == sorted(r.score for r in b) and b[0].lang_pred == "mine"
    none = {r.score for r in qm.classify(edges, two).where(F.col("doc_id").isin(2, 3, 4)).collect()}
    assert len(none) == 1
    assert qm.classify(nothing, two).count() == 0
