"""Run a query in Spark and its SQL in DuckDB and compare the two as bags of rows."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb


def connect(root: str):
    con = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        src = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{src}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _plain(x)) for k, x in v.asDict().items()))
    return v


def compare(spark, con, root: str, name: str, query, sql: str) -> str:
    """Empty when both give the same rows under the same column names; else what differs."""
    df = query(spark, root)
    cols = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    from loomgraph.session import build_session

    root = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    qs, sqls = e.queries(), e.oracle_sql()
    for name in qs:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, root, name, qs[name], sqls[name]) or "equal"
            else:
                said = f"{qs[name](spark, root).count()} rows, no SQL"
        except Exception as x:
            said = "ERROR " + str(x)[:900]
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
