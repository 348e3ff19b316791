"""Result tables as partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.sinks.replace import replace

Names = dict[tuple[str, str], str]


def table_name(names: Names) -> Column:
    """The name of the overview table a row belongs to; marker and dataset where no name is given."""
    name = F.concat_ws("_", "marker", "dataset")
    for (marker, dataset), text in names.items():
        here = (F.col("marker") == marker) & (F.col("dataset") == dataset)
        name = F.when(here, text).otherwise(name)
    return name


def write_overviews(
    overview: DataFrame,
    path: str,
    key: str = "taxon",
    names: Names = model.TABLE_NAMES,
    fmt: str = "parquet",
) -> None:
    """Replaces path by one folder per overview table, each sorted by taxon with NULL last.

    ``names`` names the table of each marker and dataset. Sorting is by range over table and taxon, so
    the largest table is spread over many files. Until all of it is written, path holds what it held before.
    """
    order = ["table", F.asc_nulls_last(key)]
    writer = (
        overview.withColumn("table", table_name(names))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("table")
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    replace(overview.sparkSession, path, writer.format(fmt).save)
