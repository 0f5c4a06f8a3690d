"""Run queries beside their SQL: python tests/compare.py DIR NAME..."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v if isinstance(v, str) else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{glob}'")
    return con


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None) -> tuple[bool, str]:
    """Whether both give the same columns and rows, and what differs."""
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t = time.time() - t
    if sql is None:
        return True, f"{len(got)} rows, {t:.1f} s, no SQL"
    cur = (con or duck(sf_dir)).execute(sql)
    want = cur.fetchall()
    a, b = rows_of(df.columns, got), rows_of([d[0] for d in cur.description], want)
    if a == b:
        return True, f"{len(got)} rows, {t:.1f} s"
    if a[0] != b[0]:
        return False, f"columns {a[0]} and {b[0]}"
    return False, f"{len(got)} and {len(want)} rows; only Spark: {list((a[1] - b[1]).items())[:3]}; only SQL: {list((b[1] - a[1]).items())[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    q, s = e.queries(), e.oracle_sql()
    con, bad = duck(sys.argv[1]), 0
    for name in sys.argv[2:] or q:
        for n in [x for x in q if x == name or (name.endswith("*") and x.startswith(name[:-1]))]:
            try:
                ok, said = compare(spark, sys.argv[1], n, q[n], s.get(n), con)
            except Exception as x:
                ok, said = False, f"{type(x).__name__}: {str(x)[:1500]}"
            bad += not ok
            print("ok  " if ok else "FAIL", n, said, flush=True)
    print("failed:", bad)
