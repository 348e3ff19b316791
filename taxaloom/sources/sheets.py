"""Readers for exported sheets (CSV with a header line, or Parquet)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaloom import model
from taxaloom.functions import numbers, text
from taxaloom.operators import cohort, naming, quality
from taxaloom.operators.reshape import melt_array
from taxaloom.plans.prepare import Study
from taxaloom.sources.ordinals import with_row_number


@dataclass(frozen=True)
class AbundanceSheet:
    """A wide count sheet: otu, otu_pos, header, counts (an array) and the names of the counted columns."""

    marker: str
    rows: DataFrame
    titles: Sequence[str]

    @property
    def headers(self) -> DataFrame:
        """The sample columns as rows: marker, sample_pos, sample. As many as the schema has."""
        named = [(self.marker, i, c) for i, c in enumerate(self.titles, start=1)]
        return self.rows.sparkSession.createDataFrame(
            named, "marker string, sample_pos int, sample string"
        )

    @property
    def wide(self) -> DataFrame:
        """One row per OTU with all its counts."""
        marker = F.lit(self.marker).alias("marker")
        return self.rows.select(marker, "otu", "otu_pos", "header", "counts")

    @property
    def cells(self) -> DataFrame:
        """One row per OTU and sample column. Header, genus and species are made once per OTU."""
        header = F.col("header")
        named = self.rows.withColumns({"genus": text.genus(header), "species": text.species(header)})
        ids = ["otu", "otu_pos", "header", "genus", "species"]
        long = melt_array(named, ids, F.col("counts"))
        return long.select(F.lit(self.marker).alias("marker"), *ids, "sample_pos", "reads")

    @property
    def otus(self) -> DataFrame:
        return self.rows.select("otu", "otu_pos", "header")


@dataclass(frozen=True)
class _Sheet:
    """An opened file or folder: the titles of its columns as they stand there, and its rows."""

    titles: Sequence[str]
    frame: DataFrame

    def column(self, place: int) -> Column:
        """The column at a place from 0."""
        return F.col(f"`{self.frame.columns[place]}`")

    def named(self, title: str, among: Sequence[int] | None = None) -> Column:
        """The column with this title, in any case if none has it as it is. None or several are refused by name."""
        places = range(len(self.titles)) if among is None else among
        found = [i for i in places if self.titles[i] == title]
        found = found or [i for i in places if self.titles[i].lower() == title.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found) or 'no'} columns named {title!r}")
        return self.column(found[0])


def _open(spark: SparkSession, path: str, fmt: str) -> _Sheet:
    """A CSV's header line is read apart from its rows, since the reader would rename titles that repeat in any case.

    Rows are then known by place, and all their fields are text.
    """
    if fmt != "csv":
        frame = spark.read.format(fmt).load(path)
        return _Sheet(frame.columns, frame)
    first = spark.read.csv(path).first()
    if first is None:
        raise ValueError(f"no header line in {path}")
    titles = [(t or "").removeprefix("\ufeff") for t in first]  # spreadsheets put a byte order mark in front
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(1, len(titles) + 1)])
    return _Sheet(titles, spark.read.schema(schema).option("header", True).csv(path))


def read_abundance_sheet(
    spark: SparkSession,
    path: str,
    marker: str,
    fmt: str = "csv",
    first: int = model.FIRST_SAMPLE_COLUMN,
    last: int | None = None,
    ordinal: str | None = None,
    landing: str | None = None,
    otu_type: str = "long",
    reads_type: str = "long",
) -> AbundanceSheet:
    """A count sheet whose sample columns stand at positions first..last, counted from 1.

    Without ``last`` all columns from ``first`` on are samples. A range that the sheet does not have is
    refused. Titles of sample columns may repeat. ``ordinal`` names a column that numbers the rows. Without it rows are
    numbered as they stand in the files, for which a CSV is written once to the folder ``landing``.
    ``otu_type`` is ``long`` or ``string``. ``reads_type`` is ``long``, and then a cell that is no whole number is
    refused by its place, or ``double`` for shares and other measures.
    """
    if reads_type not in ("long", "double"):
        raise ValueError(f"reads_type must be long or double, not {reads_type!r}")
    sheet = _open(spark, path, fmt)
    width = len(sheet.titles)
    end = width if last is None else last
    if not 1 <= first <= end <= width:
        raise ValueError(f"sample columns {first}..{end} asked for, the sheet has {width} columns")
    places = [i for i in range(first - 1, end) if sheet.titles[i] != ordinal]
    titles = [sheet.titles[i] for i in places]
    attributes = [i for i in range(width) if i not in set(places)]
    otu = sheet.named("OTU", attributes)
    kept = [
        (numbers.whole_id(otu) if otu_type == "long" else otu.cast("string")).alias("otu"),
        sheet.named("header", attributes).alias("header"),
    ]
    fields = [sheet.column(i) for i in places]
    types = {sheet.frame.schema[i].dataType for i in places}
    if reads_type == "long" and all(isinstance(t, T.IntegralType) for t in types):
        counts = F.array(*[f.cast("long") for f in fields])
    else:
        # One array of all fields, then one expression for its cells: 170 expressions would not be compiled.
        given = F.array(*[f if len(types) == 1 else f.cast("string") for f in fields])
        names = F.array(*[F.lit(t) for t in titles])
        counts = numbers.checked_counts(given, names, F.concat(F.lit("OTU "), otu.cast("string")), reads_type)
    kept.append(counts.alias("counts"))
    if ordinal is not None:
        position = sheet.named(ordinal).cast("long").alias("otu_pos")
        return AbundanceSheet(marker, sheet.frame.select(*kept, position), titles)
    rows = with_row_number(sheet.frame.select(*kept), "otu_pos", fmt, landing=landing)
    return AbundanceSheet(marker, rows, titles)


def read_sample_sheet(
    spark: SparkSession, path: str, fmt: str = "csv", landing: str | None = None
) -> DataFrame:
    """pos, site, diseased, sample from the first three columns, whatever they are called."""
    sheet = _open(spark, path, fmt)
    if len(sheet.titles) < 3:
        raise ValueError(f"a sample sheet has three columns, this one {len(sheet.titles)}")
    kept = [sheet.column(i).cast("string").alias(name) for i, name in enumerate(("site", "diseased", "sample"))]
    return with_row_number(sheet.frame.select(*kept), "pos", fmt, landing=landing)


def read_genus_lookup(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """genus, description."""
    sheet = _open(spark, path, fmt)
    return sheet.frame.select(*[sheet.named(c).alias(c) for c in ("genus", "description")])


def study_from_sheets(
    by_position: AbundanceSheet,
    by_own_names: AbundanceSheet,
    sample_sheet: DataFrame,
    genus_info: DataFrame,
    appended: Sequence[str] = (),
) -> Study:
    """A study of two sheets: one named by the sample sheet's row order, one by its own headers.

    The sample sheet must have as many rows as the first sheet has sample columns, since its rows name them.
    """
    quality.require_as_many(
        sample_sheet.count(), len(by_position.titles), f"sample sheet and columns of {by_position.marker}"
    )
    names = naming.names_by_position(sample_sheet, by_position.marker).unionByName(
        naming.own_names(by_own_names.headers)
    )
    return Study(
        cells=by_position.cells.unionByName(by_own_names.cells),
        otus=by_position.otus.withColumn("marker", F.lit(by_position.marker)).unionByName(
            by_own_names.otus.withColumn("marker", F.lit(by_own_names.marker))
        ),
        names=names,
        samples=cohort.sample_dimension(sample_sheet, appended),
        genus_info=genus_info,
        rows=by_position.wide.unionByName(by_own_names.wide),
    )
