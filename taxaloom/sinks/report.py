"""The per-sample report as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.sinks.replace import replace


def write_report(lines: DataFrame, path: str) -> None:
    """Replaces path by one folder per marker; its part files in order of part number are the report.

    One range shuffle on the full sort key. Its last column is unique within a sample, so the lines
    of a large sample spread over many tasks. Until all of it is written, path holds what it held before.
    """
    order = ["marker", "sample_pos", "block", F.desc("reads"), "otu_pos"]
    writer = (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("marker", "text")
        .write.partitionBy("marker")
    )
    replace(lines.sparkSession, path, writer.text)
