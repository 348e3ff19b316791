"""Size checks in front of broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of df, from one aggregate over it."""
    width = F.lit(ROW_OVERHEAD)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.lit(16) + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            width = width + F.lit(8)
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it measures at most max_bytes, else df as it is.

    Meant for dimensions. Without the hint Spark plans a shuffled join and adaptive execution splits
    its skewed partitions, so a dimension that outgrows the bound still joins.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
