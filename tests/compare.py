"""Runs registered queries against their SQL on DuckDB: python tests/compare.py [name-part ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("compare").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def kinds(data):
    """Value types per column, NULLs left out."""
    return [{type(r[i]).__name__ for r in data if r[i] is not None} for i in range(len(data[0]))]


def compare(spark, con, sf, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return (len(got) > 0, f"{len(got)} rows (no SQL)", t1 - t0)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    t2 = time.time()
    tail = f"{len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", t1 - t0
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", t1 - t0
    if not got:
        return False, "no rows", t1 - t0
    for name, a, b in zip(sorted(names), kinds(got), kinds(want)):
        if a and b and a != b:
            return False, f"column {name} is {a} here and {b} in SQL", t1 - t0
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {sorted(names)}\n   {bad[0][0]}\n   {bad[0][1]}", t1 - t0
    return True, tail, t1 - t0


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    parts = sys.argv[1:]
    failed = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, text, _ = compare(spark, con, sf, fn, sql.get(name))
        except Exception as exc:  # report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
