"""How many healthy and sick samples contain a taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.functions.numbers import rate


def prevalence(present: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts and rates per marker, dataset and taxon.

    ``present`` has one row per sample and taxon. Status becomes two columns by conditional counts:
    the same table as a pivot over the two values with 0 as default, in one aggregation.
    ``totals`` has one row per dataset, two at most, which bounds the broadcast.
    """
    counted = present.groupBy("marker", "dataset", "taxon").agg(
        F.count_if(F.col("status") == "healthy").alias("healthy"),
        F.count_if(F.col("status") == "sick").alias("sick"),
    )
    return (
        counted.join(F.broadcast(totals), "dataset", "left")
        .withColumns(
            {
                "healthy_freq": rate(F.col("healthy"), F.col("healthy_total")),
                "sick_freq": rate(F.col("sick"), F.col("sick_total")),
            }
        )
        .select(
            "marker",
            "dataset",
            "taxon",
            "healthy",
            "sick",
            "healthy_total",
            "sick_total",
            "healthy_freq",
            "sick_freq",
        )
    )
