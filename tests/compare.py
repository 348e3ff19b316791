"""Spark results next to DuckDB results of the same query."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


def difference(con: duckdb.DuckDBPyConnection, sql: str, df: DataFrame) -> str | None:
    """What differs, or None: column names, row count, values in any row order."""
    result = con.execute(sql)
    expected_columns = [c[0] for c in result.description]
    if sorted(expected_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(expected_columns)}"
    expected = _sorted_rows(expected_columns, result.fetchall())
    actual = _sorted_rows(df.columns, df.collect())
    if len(actual) != len(expected):
        return f"{len(actual)} rows instead of {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"row {a} instead of {e}"
        if [type(x) for x in a] != [type(x) for x in e]:
            return f"types of {a} differ from {e}"
    return None
