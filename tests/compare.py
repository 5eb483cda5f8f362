"""Run registered queries against their SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, fn, sql):
    """(ok, message, seconds)."""
    start = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows (no SQL)", took
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", took
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, f"{len(a)} rows", took
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return False, f"{len(a)} vs {len(b)} rows; spark-only {sorted(sa - sb)[:3]}; sql-only {sorted(sb - sa)[:3]}", took


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from kittally.session import build_session

    sf = argv[0]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in argv[1:]):
            continue
        try:
            ok, message, took = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as exc:  # show every failure of a run, not the first
            ok, message, took = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s {message[:1800]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
