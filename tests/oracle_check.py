"""Comparison of a Spark result with DuckDB over the same folder."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert got == want, (len(got), len(want), [x for x in got if x not in want][:2], [x for x in want if x not in got][:2])
