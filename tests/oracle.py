"""Runs a query's oracle in DuckDB and compares rows regardless of order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) else v


def rows(columns, records) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def same(df, con, sql: str) -> None:
    got = rows(df.columns, df.collect())
    res = con.sql(sql)
    want = rows(res.columns, res.fetchall())
    assert sorted(df.columns) == sorted(res.columns)
    assert len(got) == len(want)
    assert got == want
