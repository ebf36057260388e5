"""Rows of Spark and DuckDB side by side, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, (float, np.floating)) and np.isnan(value)):
        return "null"
    if isinstance(value, (float, np.floating)):
        return f"{float(value):.6f}"
    return str(list(value)) if isinstance(value, (list, np.ndarray)) else str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))
