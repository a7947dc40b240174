"""Run registered queries in Spark and their DuckDB twins; compare results.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from riskfold.sources.tables import TABLE_NAMES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v.is_integer():
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return v.item()
    return v


def compare(spark, con, name, entry, sf_dir):
    t0 = time.time()
    sdf = entry.fn(spark, sf_dir)
    spd = sdf.toPandas()
    t1 = time.time()
    if entry.sql is None:
        return "rows-only", len(spd), t1 - t0, 0.0, ""
    dpd = con.execute(entry.sql).df()
    t2 = time.time()
    msg = ""
    if sorted(spd.columns) != sorted(dpd.columns):
        return "FAIL", len(spd), t1 - t0, t2 - t1, f"columns {sorted(spd.columns)} vs {sorted(dpd.columns)}"
    cols = sorted(spd.columns)
    a = sorted(tuple(str(norm(x)) if x is not None else "None" for x in r) for r in
               spd[cols].astype(object).where(spd[cols].notna(), None).itertuples(index=False))
    b = sorted(tuple(str(norm(x)) if x is not None else "None" for x in r) for r in
               dpd[cols].astype(object).where(dpd[cols].notna(), None).itertuples(index=False))
    if len(a) != len(b):
        return "FAIL", len(a), t1 - t0, t2 - t1, f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        msg = f"{len(bad)} rows differ, e.g. {bad[0]}"
        return "FAIL", len(a), t1 - t0, t2 - t1, msg
    return "PASS", len(a), t1 - t0, t2 - t1, msg


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from riskfold.catalog import REGISTRY
    from riskfold.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    for name, entry in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            st, n, ts, td, msg = compare(spark, con, name, entry, sf_dir)
        except Exception as e:  # noqa: BLE001
            st, n, ts, td, msg = "ERROR", 0, 0, 0, repr(e)[:300]
        print(f"{st:9s} {name:28s} rows={n:<8d} spark={ts:6.1f}s duck={td:5.1f}s {msg}", flush=True)


if __name__ == "__main__":
    main()
