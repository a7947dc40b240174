"""Ranked lexical search against brute force, bounds, edge cases."""

import math
import random
import re

import numpy as np
import pytest

from riskfold.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, cut(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for name, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, w in bags:
            m, s = 10 + 90 * len(w) * n_docs // total, 0
            for t in set(cut(text)):
                tf = w.count(t)
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(name, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=300, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Äh", "東京", "x_y", "a-b", "ß1"]
    docs = [(i, " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=rnd.randint(0, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # one large group of copies
    items = [(i, " ".join(rnd.sample(vocabulary, rnd.randint(0, 12)))) for i in range(25)] + [(90, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("shape", [(4096, 64, 2000), (50, 4, 7), (1000, 1, 3)])
def test_search_equals_brute_force(spark, shape):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search_documents(d, i, block_rows=shape[0], leaf=shape[1], most_items=shape[2]).collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(docs, items)


def test_edges_and_clashing_columns(spark, edges, clashing, nothing):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    items = [(1, "the King of the hund"), (1, "the King of the hund"), (2, None), (3, "..."), (4, "no_such"), (5, "東京 ½ line"), (None, "the dog")]
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'mine' as rank", "'mine' as score", "'mine' as item")
    for table in (edges, clashing):
        found = lexical.search_documents(table, i).collect()
        assert sorted([tuple(r) for r in found], key=str) == brute(docs, items)
    assert lexical.search_documents(nothing, i).count() == 0
    assert lexical.search_documents(edges, i.limit(0)).count() == 0


def built(seed, rows=400, width=60, leaf=8):
    rnd = np.random.default_rng(seed)
    size = rnd.integers(1, 12, rows)
    centres = rnd.integers(0, width, (6, 12))
    cols = np.concatenate([rnd.choice(centres[r % 6], n, replace=False) if n <= len(set(centres[r % 6])) else rnd.permutation(width)[:n] for r, n in enumerate(size)])
    parts = np.split(cols, np.cumsum(size)[:-1])
    parts = [np.unique(p) for p in parts]
    size, cols = np.array([len(p) for p in parts]), np.concatenate(parts)
    vals = rnd.integers(1, 10**9, len(cols))
    queries = lexical.Queries.of([(i, " ".join(f"t{c}" for c in rnd.choice(width, 6))) for i in range(20)])
    place = {int(t[1:]): p for t, p in queries.places.items()}
    keep = np.isin(cols, list(place))
    row = np.repeat(np.arange(rows), size)[keep]
    kept, starts = np.unique(row, return_index=True)
    cols = np.array([place[int(c)] for c in cols[keep]])
    return lexical.Tree(starts, cols, vals[keep], len(place), queries, leaf), kept


def test_bounds_hold_for_every_node_and_subtrees_are_pruned():
    tree, kept = built(1)
    below = {}
    for node in range(len(tree.bounds) - 1, -1, -1):
        kids = tree.children[node]
        below[node] = tree.leaves[node][0] if kids is None else np.concatenate([below[k] for k in kids])
    assert sorted(below[0]) == list(range(len(kept)))
    exact = np.zeros((len(kept), len(tree.queries.ids)), np.int64)
    for i in range(len(tree.queries.ids)):
        wanted = np.zeros(tree.width, np.int64)
        wanted[tree.queries.of_item(i)] = 1
        exact[:, i] = np.add.reduceat(tree.vals * wanted[tree.cols], tree.starts)
    for node, rows in below.items():
        assert (exact[rows].max(0) <= tree.bounds[node]).all()
    best = [lexical.Best(3) for _ in tree.queries.ids]
    opened = lexical.search(tree, np.arange(len(kept)), np.zeros(len(kept), bool), best)
    assert opened < len(tree.leaves) * len(best)
    for i, b in enumerate(best):
        order = sorted((-s, r) for r, s in enumerate(exact[:, i]) if s > 0)[:3]
        assert [(int(-s), int(r)) for s, r in zip(b.scores, b.ids)] == [(s, r) for s, r in order]
