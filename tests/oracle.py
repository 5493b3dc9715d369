"""Spark rows against DuckDB rows over the same parquet tables."""

import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            p = f"{sf_dir}/{f}"
            con.execute(f"create view {f[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)


def duck_rows(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)
