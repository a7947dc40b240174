"""The SQL twin's greedy walk (recursive CTE) drops the same features as the
driver-side greedy pass, on random edge graphs with low-variance features
(the driver's tables never cross the correlation threshold, so the oracle
alone would not exercise a drop)."""

import duckdb
import numpy as np
import pytest

from riskfold import sql_twins as Q
from riskfold.operators.prep import greedy_prune
from riskfold.sources.tables import ACCOUNTS


def _walk_sql() -> str:
    text = Q.selection_ctes(ACCOUNTS)
    return text[text.index("pstep AS MATERIALIZED"):text.index("kept0 AS")].rstrip().rstrip(",")


@pytest.mark.parametrize("seed", range(8))
def test_recursive_walk_equals_greedy(seed):
    rng = np.random.default_rng(seed)
    con = duckdb.connect()
    expected = {}
    cand, edges = [], []
    for g in (-1, 0, 1):
        p = int(rng.integers(1, 14))
        low = {i for i in range(p) if rng.random() < 0.15}
        es = {(i, j) for i in range(p) for j in range(i + 1, p) if rng.random() < 0.25}
        dropped = greedy_prune(list(range(p)), low, es)
        expected[g] = {i: (i not in dropped, dropped.get(i)) for i in range(p)}
        cand += [(g, i, f"f{i}", 1.0, i in low) for i in range(p)]
        edges += [(g, i, j) for i, j in es]
    con.execute("CREATE TABLE grp AS SELECT * FROM (VALUES (-1), (0), (1)) t(g)")
    con.execute("CREATE TABLE pcand (g INTEGER, pos INTEGER, feature VARCHAR, var_samp DOUBLE, low BOOLEAN)")
    con.executemany("INSERT INTO pcand VALUES (?, ?, ?, ?, ?)", cand)
    con.execute("CREATE TABLE pedge (g INTEGER, pa INTEGER, pb INTEGER)")
    if edges:
        con.executemany("INSERT INTO pedge VALUES (?, ?, ?)", edges)
    rows = con.execute("WITH RECURSIVE " + _walk_sql() + " SELECT g, pos, kept, reason FROM sel").fetchall()
    got = {}
    for g, pos, kept, reason in rows:
        got.setdefault(g, {})[pos] = (kept, reason)
    assert got == expected
