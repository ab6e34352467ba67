"""Comparison of a query's rows in Spark with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> Counter:
    return Counter(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str) -> int:
    """Assert equal rows; how many there are."""
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    return len(got)
