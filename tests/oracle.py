"""Runs queries beside their DuckDB SQL."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


def same(con, sql, df):
    """Rows of both sides that the other lacks (both empty if they agree)."""
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.sql(sql)
    names = result.columns
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
