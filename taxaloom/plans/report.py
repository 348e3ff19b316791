"""The ranked report per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaloom import model
from taxaloom.functions import text
from taxaloom.operators import presence, ranking
from taxaloom.plans.prepare import Study

# Blocks of a sample's section, in the order they are written.
HEADING, GAP, TITLE, RULE, ROWS, END = range(6)


def report_lines(study: Study) -> DataFrame:
    """Every line of the report: marker, sample_pos, block, reads, otu_pos, text.

    Lines are in report order when sorted by marker, sample_pos, block, descending reads, otu_pos.
    """
    hits = ranking.sample_hits(study.cells, study.columns)

    def line(block: int, value: Column) -> Column:
        return F.struct(F.lit(block).alias("block"), value.alias("text"))

    heading = line(HEADING, F.concat(F.lit(model.REPORT_HEADING), F.col("sample")))
    empty = [
        heading,
        line(GAP, F.lit("")),
        line(TITLE, F.lit(model.REPORT_NO_HITS)),
        line(END, F.lit("")),
    ]
    table = [
        heading,
        line(GAP, F.lit("")),
        line(TITLE, F.lit(model.REPORT_COLUMNS)),
        line(RULE, F.lit(model.REPORT_RULE)),
        line(END, F.lit("")),
    ]
    frames = hits.select(
        "marker",
        "sample_pos",
        F.explode(F.when(F.col("hits") == 0, F.array(*empty)).otherwise(F.array(*table))).alias("line"),
    ).select(
        "marker",
        "sample_pos",
        "line.block",
        F.lit(None).cast("long").alias("reads"),
        F.lit(None).cast("long").alias("otu_pos"),
        "line.text",
    )
    shown = presence.with_header(ranking.hit_cells(study.cells), study.otus)
    fractional = isinstance(study.cells.schema["reads"].dataType, T.FractionalType)
    reads = text.plain_number(F.col("reads")) if fractional else F.col("reads")
    fields = [F.col("otu"), F.substring("header", 1, model.REPORT_INFO_WIDTH), reads]
    rows = shown.select(
        "marker",
        "sample_pos",
        F.lit(ROWS).alias("block"),
        "reads",
        "otu_pos",
        text.joined_fields(fields, model.REPORT_SEPARATOR).alias("text"),
    )
    return frames.unionByName(rows)


def ranked_otus(study: Study) -> DataFrame:
    """The OTUs of each sample by descending reads, with their rank."""
    named = study.columns.select("marker", "sample_pos", "sample")
    return ranking.ranked(study.cells).join(named, ["marker", "sample_pos"])
