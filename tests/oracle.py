"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    own = duckdb.connect()
    own.sql("SET timezone = 'UTC'")
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return own


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    names = sorted(df.columns)
    out = df[names].copy()
    for c in names:
        if out[c].dtype.kind in "fiu" or str(out[c].dtype).startswith("Int"):
            out[c] = out[c].astype(float)
    return out.sort_values(names, kind="stable").reset_index(drop=True)


def assert_same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) == len(expected)
    a, b = canonical(found), canonical(expected)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), f"{c}: {a[c][~same].head(3).tolist()} and {b[c][~same].head(3).tolist()}"
