"""Runs registered queries next to their SQL twins; `python -m tests.oracle [names]`."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

from oddsframe.plans.fx import TABLES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if value != value else (int(value) if value == int(value) and abs(value) < 1e15 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql):
    df = query(spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return len(got), ""
    only_got = sorted(set(got) - set(want), key=repr)[:3]
    only_want = sorted(set(want) - set(got), key=repr)[:3]
    return len(got), f"{len(got)} vs {len(want)} rows\n   cols {sorted(names)}\n   spark {only_got}\n   sql   {only_want}"


def main(names):
    import __spark_entry__ as entry
    from oddsframe.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con, bad = entry.queries(), entry.oracle_sql(), duck(), []
    picked = [q for q in queries if not names or any(q == n or q.startswith(n) for n in names)]
    for q in picked:
        t0 = time.time()
        try:
            n, problem = compare(spark, con, q, queries[q], oracles.get(q))
        except Exception as e:  # report and go on
            n, problem = -1, "EXC " + str(e)[:1500]
        state = "rows-only" if problem is None else ("ok" if problem == "" else "DIFF")
        print(f"{state:9} {q:34} {n:8} rows {time.time() - t0:6.2f}s {problem or ''}", flush=True)
        if problem:
            bad.append(q)
    print("queries", len(picked), "bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
