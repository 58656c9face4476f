"""Compare a Spark result with SQL run by DuckDB over the same tables."""

import math
import os

import duckdb


def same(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def against_sql(df, sql, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    want = sorted([tuple(same(r[k]) for k in at) for r in rel.fetchall()])
    got = sorted([tuple(same(r[c]) for c in columns) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
