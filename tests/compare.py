"""Query against SQL on the same tables, by sorted columns and rows."""

import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


def same(df, con, sql):
    out = con.sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    got, want = rows(df.columns, df.collect()), rows(out.columns, out.fetchall())
    assert got == want
    return len(got)
