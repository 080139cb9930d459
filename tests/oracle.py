"""Compares a query with its SQL in DuckDB: the same columns, the same rows in any order."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "NaN" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def differences(spark, con, d, query, sql):
    df = query(spark, d)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows(names, cur.fetchall())
    missing, extra = sorted(set(want) - set(got))[:3], sorted(set(got) - set(want))[:3]
    return None if got == want else f"{len(got)} rows for {len(want)}; missing {missing}; extra {extra}"
