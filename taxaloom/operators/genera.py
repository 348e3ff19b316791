"""Selection of OTUs by what is known about their genus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.functions.sizing import broadcast_if_small
from taxaloom.functions.text import genus


def included_genera(
    genus_info: DataFrame, description: str = model.INCLUDED_DESCRIPTION
) -> DataFrame:
    """Genera with the given description."""
    return genus_info.filter(F.col("description") == description).select("genus").distinct()


def excluded_out_genera(
    genus_info: DataFrame, descriptions: Sequence[str] = model.EXCLUDED_DESCRIPTIONS
) -> DataFrame:
    """Genera with none of the given descriptions. A genus without description stays in."""
    listed = F.coalesce(F.col("description").isin(*descriptions), F.lit(False))
    return genus_info.filter(~listed).select("genus").distinct()


def rows_of(rows: DataFrame, genera: DataFrame) -> DataFrame:
    """Rows or cells whose own genus is listed, judged by the header each carries.

    Genera that measure small are broadcast, so the rows stay where they are.
    """
    own = F.col("genus") if "genus" in rows.columns else genus(F.col("header"))
    listed = broadcast_if_small(genera.select(F.col("genus").alias("_genus")))
    return rows.join(listed, own == F.col("_genus"), "left_semi")


def otus_of(otus: DataFrame, genera: DataFrame) -> DataFrame:
    """OTUs whose genus is listed. An OTU without header has no genus and is left out.

    The join type is left to Spark, which broadcasts the genera if they measure small at run time
    and else splits the partitions of a genus that holds many OTUs.
    """
    return otus.withColumn("genus", genus(F.col("header"))).join(genera, "genus", "left_semi")
