"""A query's rows against its SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def text(v: object) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, int | float) or hasattr(v, "dtype"):
            return str(round(float(v), 6) + 0.0)
        return str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def agree(spark, con: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> None:
    ours, theirs = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
