"""Compare registered queries with their SQL in DuckDB. Run: python tests/oracle.py [sf] [name prefix ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(i) for i in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(i)) for k, i in v.items()))
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark, con, name, run, sql, folder):
    got = run(spark, folder)
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(set(got.columns) ^ set(names))}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if mine == theirs:
        return ""
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    cols = sorted(names)
    a, b = bad[0]
    where = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
    return f"{len(bad)} of {len(mine)} rows differ, first: {where[:4]}"


def main():
    from stayscope.session import local_session
    from stayscope.suite.all_queries import ORACLE, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = differences(spark, con, name, run, ORACLE[name], folder)
            else:
                problem = "" if run(spark, folder).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in ORACLE else "ok (rows only)")
        print(f"{mark:5} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
