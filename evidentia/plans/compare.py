"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    def show(x: object) -> str:
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return str([show(y) for y in x])
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x):.9g}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    columns = sorted(frame.columns)
    return sorted(tuple(show(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


def differences(spark: SparkSession, query, sql: str, sf_dir: str) -> str:
    """Empty if columns and rows agree."""
    mine, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = _rows(mine), _rows(theirs)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows, e.g. {only_a} and {only_b}"
