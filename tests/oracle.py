"""Run registered queries against their DuckDB twins and compare types and values, ignoring row order."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ("n",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, int):
        return ("i", v)
    return (type(v).__name__, str(v))


KIND = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "double": "double", "string": "string", "varchar": "string", "boolean": "bool"}


def compare(spark, con, sf: str, name: str, q) -> str:
    """Empty string when both sides agree, otherwise what differs."""
    got = q.run(spark, sf)
    rows = [tuple(r) for r in got.collect()]
    if q.sql is None:
        return "" if rows else "EMPTY (no oracle)"
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    kinds = [str(d[1]).lower() for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    s_kind = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in got.schema}
    d_kind = {n: KIND.get(k, k) for n, k in zip(names, kinds)}
    bad = {n: (s_kind[n], d_kind[n]) for n in names if s_kind[n] != d_kind[n]}
    if bad:
        return f"types {bad}"
    order = sorted(names)
    gi = [got.columns.index(n) for n in order]
    wi = [names.index(n) for n in order]
    a = sorted(tuple(norm(r[i]) for i in gi) for r in rows)
    b = sorted(tuple(norm(r[i]) for i in wi) for r in want)
    if a == b:
        return "" if rows else "EMPTY on both sides"
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"rows {len(a)} vs {len(b)}; spark only {only_a}; duckdb only {only_b} ({order})"


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from tidemark.plans import registry
    from tidemark.session import get_spark

    sf = argv[0]
    picks = argv[1:]
    wanted = picks.pop(0)[1:].split(",") if picks and picks[0].startswith("@") else None
    loaded = registry.load_all(wanted)
    if wanted:
        loaded = {n: q for n, q in loaded.items() if q.run.__module__.rsplit(".", 1)[1] in wanted}
    spark = get_spark("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    if "ROWS_PER_TASK" in os.environ:
        spark.conf.set("spark.tidemark.rowsPerTask", os.environ["ROWS_PER_TASK"])
    con = connect(sf)
    failed = 0
    for name, q in loaded.items():
        if picks and name not in picks:
            continue
        t = time.time()
        try:
            msg = compare(spark, con, sf, name, q)
        except Exception as e:
            msg = f"ERROR {type(e).__name__}: {str(e)[:700]}"
            if picks:
                traceback.print_exc()
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.2f}s {msg[:1500]}", flush=True)
    print(f"{len(loaded)} registered, {failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
