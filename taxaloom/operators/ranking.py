"""Reads per sample and the order of OTUs within a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.operators.numbering import BAND_WIDTH, number_within
from taxaloom.operators.presence import with_reads


def sample_hits(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """All reads of each sample column before any filter, 0 for one without cells."""
    # A zero for every column keeps the empty ones, and blank cells count as 0.
    zeros = columns.select("marker", "sample_pos", F.lit(0).cast("long").alias("reads"))
    sums = (
        cells.select("marker", "sample_pos", "reads")
        .unionByName(zeros)
        .groupBy("marker", "sample_pos")
        .agg(F.sum("reads").alias("hits"))
    )
    return sums.join(
        columns.select("marker", "sample_pos", "sample"), ["marker", "sample_pos"]
    )


def hit_cells(cells: DataFrame, min_reads: int = model.MIN_READS_REPORT) -> DataFrame:
    """The cells a report shows."""
    return with_reads(cells, min_reads)


def ranked(cells: DataFrame, width: int = BAND_WIDTH) -> DataFrame:
    """Ranks the shown OTUs of each sample by reads, ties in sheet order."""
    return number_within(
        hit_cells(cells), ["marker", "sample_pos"], "otu_pos", "rank", descending="reads", width=width
    )
