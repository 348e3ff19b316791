"""Checks of keys that joins rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raises ValueError if two rows of df share their keys: a join on them would multiply rows."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    examples = [tuple(r[k] for k in keys) for r in repeated.take(5)]
    if examples:
        raise ValueError(f"repeated {what}: {examples}")


def require_as_many(names: int, columns: int, what: str) -> None:
    """Raises ValueError if names given by position do not match the columns they name."""
    if names != columns:
        raise ValueError(f"{names} names for {columns} columns: {what}")
