"""Which taxa occur in which samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaloom import model
from taxaloom.functions import text
from taxaloom.operators.numbering import BAND_WIDTH, number_within

RANKS = ("otu", "genus", "species")


def taxon_of(rank: str) -> Column:
    """The taxon of a row of otus or of cells with a header."""
    if rank == "genus":
        return text.genus(F.col("header"))
    if rank == "species":
        return text.species(F.col("header"))
    if rank == "otu":
        return F.col("otu")
    raise ValueError(f"rank must be one of {RANKS}, not {rank!r}")


def labelled(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells with the name and attributes of their sample column."""
    return cells.join(columns, ["marker", "sample_pos"], "left")


def with_reads(cells: DataFrame, min_reads: int) -> DataFrame:
    """Cells with at least min_reads reads; shares and other doubles count from above ``min_reads - 1``."""
    reads = F.col("reads")
    whole = not isinstance(cells.schema["reads"].dataType, T.FractionalType)
    return cells.filter(reads >= min_reads if whole else reads > min_reads - 1)


def assigned(
    cells: DataFrame, columns: DataFrame, min_reads: int = model.MIN_READS_OVERVIEW
) -> DataFrame:
    """Labelled cells of samples with a known status and at least min_reads reads."""
    known = F.col("diseased") != model.UNASSIGNED
    return labelled(with_reads(cells, min_reads), columns).filter(known)


def otu_key(otus: DataFrame) -> list[str]:
    """The columns that name an OTU: with the marker where each sheet has its own list."""
    return [c for c in ("marker", "otu") if c in otus.columns]


def with_header(cells: DataFrame, otus: DataFrame) -> DataFrame:
    """Cells with the header of their OTU, if they do not carry it already."""
    if "header" in cells.columns:
        return cells
    key = otu_key(otus)
    return cells.join(otus.select(*key, "header"), key, "left")


def with_taxon(cells: DataFrame, rank: str, otus: DataFrame | None = None) -> DataFrame:
    """Adds taxon. Cells without a header take it from otus, reduced to the taxon before the join."""
    if rank in cells.columns:  # landed cells carry genus and species
        return cells.withColumn("taxon", F.col(rank))
    if "header" in cells.columns:
        return cells.withColumn("taxon", taxon_of(rank))
    key = otu_key(otus)
    return cells.join(otus.select(*key, taxon_of(rank).alias("taxon")), key, "left")


def presence(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per sample and taxon, from assigned cells with a taxon.

    Partial aggregation removes repeats before the shuffle, so a taxon that holds most of the rows
    still sends one row per sample and task. The shuffle carries the sample as its column number;
    name and attributes are added to the distinct rows.
    """
    distinct = cells.select("marker", "sample_pos", "taxon").distinct()
    return labelled(distinct, columns).select("marker", "sample", "dataset", "status", "taxon")


def occurrences(cells: DataFrame, width: int = BAND_WIDTH) -> DataFrame:
    """Numbers the OTUs of each sample and taxon in sheet order (column ``occurrence``)."""
    # A taxon may be NULL and is a group of its own, so it enters the keys in two non-null parts.
    # Samples enter by their column number: the shuffle carries no names.
    keyed = cells.withColumns(
        {
            "_taxon": F.coalesce(F.col("taxon").cast("string"), F.lit("")),
            "_no_taxon": F.col("taxon").isNull(),
        }
    )
    keys = ["marker", "sample_pos", "_taxon", "_no_taxon"]
    numbered = number_within(keyed, keys, "otu_pos", "occurrence", width=width)
    return numbered.drop("_taxon", "_no_taxon")


def first_occurrences(cells: DataFrame) -> DataFrame:
    """The first OTU of each sample and taxon: occurrence 1, without numbering the rest."""
    # One plain column each, since a struct in the buffer would turn hashing into sorting.
    return cells.groupBy("marker", "sample", "dataset", "status", "taxon").agg(
        F.min_by("otu", "otu_pos").alias("otu"),
        F.min("otu_pos").alias("otu_pos"),
        F.min_by("reads", "otu_pos").alias("reads"),
    )
