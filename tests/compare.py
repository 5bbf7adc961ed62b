"""Runs queries and their SQL twins on one data folder and compares them."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def differs(spark, con, sf, query, sql):
    """'' if both give the same rows, else what differs."""
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got_cols else "no columns"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} and {want_cols}"
    if got != want:
        a, b = got - want, want - got
        return f"{sum(got.values())} rows and {sum(want.values())}; only Spark {list(a.items())[:3]}; only SQL {list(b.items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from tidewright.session import get_session

    spark = get_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con, qs, sqls = duck(sf), e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sorted(qs):
        t = time.time()
        try:
            said = differs(spark, con, sf, qs[name], sqls.get(name))
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
            con = duck(sf)
        bad += bool(said)
        print(f"{name}: {'ok' if not said else said} ({time.time() - t:.1f} s{'' if name in sqls else ', rows only'})", flush=True)
    print("failed", bad)
