"""Run registered queries beside their oracle SQL and compare the rows.

``python tests/oracle.py [name ...] [--sf 0.01]`` checks from the command line.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/sf{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(repr([_norm(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, f"{DATA}/sf{sf}")
    got = df.collect()
    took = time.time() - start
    columns, left = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return None, f"{len(got)} rows, no oracle, {took:.2f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    columns2, right = rows_of(names, cur.fetchall())
    took2 = time.time() - start
    if columns != columns2:
        return False, f"columns {columns} vs {columns2}"
    if left != right:
        a, b = list((left - right).elements()), list((right - left).elements())
        return False, f"{sum(left.values())} vs {sum(right.values())} rows; only spark {a[:2]}; only sql {b[:2]}"
    return True, f"{len(got)} rows, {took:.2f}s / {took2:.2f}s"


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    import __spark_entry__ as entry

    from hexvigil.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
