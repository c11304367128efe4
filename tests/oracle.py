"""Compares a query's rows with those of its SQL on the same tables."""

import math
import os

import duckdb


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return f"{float(v):.5f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def difference(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}"
    return ""
