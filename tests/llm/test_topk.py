import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import topk


def brute(ids, vectors, queries, k=10):
    v = [np.floor(1024 * np.array(x)).astype(np.int64) for x in vectors]
    out = {}
    for q in queries:
        own = v[ids.index(q)]
        rows = sorted((-int(own @ x), i) for i, x in zip(ids, v) if i != q and len(x) == len(own))
        out[q] = [(i, -s) for s, i in rows[:k]]
    return out


@pytest.mark.parametrize("case", range(4))
def test_equals_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "GROUP", 8)
    rnd, n, dim = np.random.default_rng(case), 300, 6
    m = rnd.normal(size=(n, dim)) * rnd.lognormal(0, 1, size=(n, 1))
    m[50:150], m[200:220] = m[50], 0  # a third alike, and zeros
    if case == 1:
        m = -np.abs(m)
    if case == 2:
        m = rnd.normal(size=(3, dim))[rnd.integers(0, 3, n)] + 0.05 * rnd.normal(size=(n, dim))
    rows = [(i, [float(x) for x in (r if case != 3 or i % 2 else r[:4])]) for i, r in enumerate(m)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute([i for i, _ in rows], [x for _, x in rows], range(0, n, 20))


def test_survivors_lose_nothing():
    rnd = np.random.default_rng(8)
    for _ in range(200):
        c = np.floor(1024 * rnd.normal(size=(60, 5)))
        q = np.floor(1024 * rnd.normal(size=5))
        ids, c, norms = topk._longest_first(np.arange(60), c)
        scores = topk.products(q, c)
        floor = float(np.sort(scores)[-rnd.integers(1, 40)])
        assert set(np.flatnonzero(scores >= floor)) <= set(topk.survivors(q, c, norms, floor).tolist())


def test_large_components_stay_exact():
    q = np.array([float(2 ** 31), 1.0, 3.0])
    assert topk.products(q, np.array([[float(2 ** 31), 1.0, 5.0]]))[0] == 2 ** 62 + 16
    with pytest.raises(OverflowError):
        topk.products(np.array([1e30]), np.array([[1e30]]))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, None, None), (2, [nan, 1.0], "b"), (3, [inf, 1.0], "b"), (4, [None, 1.0], "b"), (5, [], "b"), (None, [1.0, 1.0], "c"),
            (6, [0.5, 0.5], "c"), (6, [0.5, 0.5], "c"), (7, [1.0, 0.0, 0.0], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm string")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 512 * 1024), (0, 2, 6, 512 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_buckets_too_short_for_a_group_are_not_visited(spark):
    import numpy as np
    q = np.array([[3.0, 4.0], [0.0, 2.0]])
    assert topk.shortest_useful(q, np.array([50.0, 8.0])) == 4.0
    assert topk.shortest_useful(q, np.array([50.0, -np.inf])) == 0.0
    assert topk.shortest_useful(np.zeros((1, 2)), np.array([1.0])) == np.inf
    groups = spark.createDataFrame([(0, 2, 4.0), (1, 2, 0.0), (2, 3, 9.0)], "at long, dim int, need double")
    buckets = spark.createDataFrame([(2, 10, 9.0), (2, 11, 4.0), (2, 12, 3.9), (3, 13, 8.0)], "dim int, bucket long, longest double")
    got = sorted((r.at, r.bucket) for r in topk.visited(groups, buckets).collect())
    assert got == [(0, 10), (0, 11), (1, 10), (1, 11), (1, 12)]   # 5 of 7 visits
