"""Runs a query in Spark and its SQL in DuckDB and compares rows regardless of order."""

import glob
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(d):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def even(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(even(r[i]) or "" for i in order) for r in data])


def compare(spark, d, query, sql):
    got = query(spark, d)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    cur = tables(d).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert a == rows(names, cur.fetchall())
