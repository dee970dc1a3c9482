"""Run registered queries against their oracle: ``python tests/compare.py [sf] [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items(), key=str)) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in at) for r in rows), [names[i] for i in at]


def compare(spark, con, entry, sf: str):
    """'' when equal, else what differs; also the Spark row count."""
    df = entry.run(spark, sf)
    got, got_names = rows_of(df.columns, df.collect())
    if entry.sql is None:
        return "", len(got)
    res = con.execute(entry.sql)
    want, want_names = rows_of([d[0] for d in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
        return f"{len(bad)} rows differ, e.g. {diff[:4]} in {g[:6]}", len(got)
    return "", len(got)


def main():
    args = sys.argv[1:]
    conf = {}
    if "--hot" in args:  # treat keys with at least this many rows as hot, and never broadcast statistics
        at = args.index("--hot")
        conf["spark.raceflow.hotRows"] = args[at + 1]
        del args[at:at + 2]
        from raceflow import skew
        skew.BROADCAST_BYTES = 0
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    import raceflow.catalog  # noqa: F401
    from raceflow.registry import ENTRIES
    from raceflow.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                 "spark.driver.memory": "8g", **conf})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = [n for n in ENTRIES if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1]))
             or ENTRIES[n].run.__module__.endswith("." + a) for a in args)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem, n = compare(spark, con, ENTRIES[name], sf)
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok  " if ENTRIES[name].sql else "rows")
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main()
