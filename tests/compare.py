"""Side-by-side comparison of a query with its SQL twin: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "-"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(pd.Timestamp(value)) if hasattr(value, "year") else str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty if both hold the same rows, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    # whole numbers with NULLs come as floats from one side and as nullable integers from the other
    whole = [c for c in sql_frame.columns if str(sql_frame[c].dtype).startswith("Int") and str(spark_frame[c].dtype) == "float64"]
    ours, theirs = rows_of(spark_frame.astype(dict.fromkeys(whole, "Int64"))), rows_of(sql_frame)
    if ours == theirs:
        return ""
    only_ours = sorted(set(ours) - set(theirs))
    only_theirs = sorted(set(theirs) - set(ours))
    return f"{len(ours)} / {len(theirs)} rows, {len(only_ours)} only here, e.g. {only_ours[:2]} / {only_theirs[:2]}"
