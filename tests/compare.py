"""Comparison of a Spark result with DuckDB's over the same files."""

from pathlib import Path

import duckdb
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "")
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame, exact: bool = True) -> None:
    pd.testing.assert_frame_equal(_sorted(ours.copy()), _sorted(theirs.copy()), check_dtype=False, rtol=0, atol=1e-9 if exact else 1e-6)
