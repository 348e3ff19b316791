"""Reader for a landed study."""

from __future__ import annotations

from pyspark.sql import SparkSession

from taxaloom.plans.prepare import Study
from taxaloom.sinks.landing import PARTS


def study_from_tables(spark: SparkSession, prefix: str) -> Study:
    """The study written by ``sinks.landing.land`` under the same prefix."""
    return Study(
        cells=spark.table(f"{prefix}_cells"),
        **{part: spark.table(f"{prefix}_{part}") for part in PARTS},
    )
