"""Running numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAND_WIDTH = 1_000_000


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    name: str,
    descending: str | None = None,
    width: int = BAND_WIDTH,
) -> DataFrame:
    """Numbers the rows of each group from 1, by ``descending`` first if given, then by ordinal.

    The same numbers as ``row_number`` over the whole group, but a group is cut into bands of
    ``width`` ordinals and each band is numbered on its own, then shifted by the rows ahead of it.
    The ordinal is unique in a group, so one task never sorts more than ``width`` rows of a group.
    The counts come from a pre-aggregation. Those summed up in one window are one row per band, or
    one per distinct value of ``descending``: for counts of total T at most sqrt(2 T) rows.
    Only bands with rows ahead of them are joined back. Keys must not be NULL.
    """
    values = [descending] if descending else []
    # The band is declared non-null, so no filter on it is pushed into one branch only and Spark
    # computes df once for both.
    band = F.coalesce(F.floor(F.col(ordinal) / F.lit(width)), F.lit(0))
    banded = df.withColumn("_band", band)
    counts = banded.groupBy(*keys, *values, "_band").agg(F.count("*").alias("_n"))
    ahead = (W.unboundedPreceding, -1)
    by_band = W.partitionBy(*keys, *values).orderBy("_band").rowsBetween(*ahead)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(by_band), F.lit(0)))
    if descending:
        by_value = W.partitionBy(*keys).orderBy(F.desc(descending)).rowsBetween(*ahead)
        larger = (
            counts.groupBy(*keys, descending)
            .agg(F.sum("_n").alias("_n"))
            .select(
                *keys, descending, F.coalesce(F.sum("_n").over(by_value), F.lit(0)).alias("_larger")
            )
        )
        shifts = shifts.join(larger, [*keys, descending]).withColumn(
            "_shift", F.col("_shift") + F.col("_larger")
        )
    shifts = shifts.select(*keys, *values, "_band", "_shift").filter("_shift > 0")
    inside = W.partitionBy(*keys, *values, "_band").orderBy(ordinal)
    number = F.row_number().over(inside) + F.coalesce("_shift", F.lit(0))
    return (
        banded.join(shifts, [*keys, *values, "_band"], "left")
        .select(*df.columns, number.alias(name))
    )
