"""The shared test tables seen as a study (mapping in FIXTURES.md).

A sample is a nation and market segment, an OTU is a part, and the reads of a cell are the quantity
of the part that customers of the sample ordered. Line items with status O are marker ITS1, all others
ITS2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import cycle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.operators import cohort, naming
from taxaloom.operators.reshape import widen
from taxaloom.plans.prepare import Study
from taxaloom.sources import sheets

# The columns in use. A given schema saves opening the files at planning time.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_partkey long, l_quantity double, l_linestatus string",
    "part": "p_partkey long, p_name string, p_brand string, p_size int",
}

# Fixed values of the mapping.
APPENDED_SAMPLES = ("PCR_neg_5",)
SHEET_NAME = """
    CASE WHEN pos % 31 = 0 THEN concat('PCR_neg_', pos DIV 31)
         WHEN pos % 29 = 0 THEN concat('Ex_con_', pos)
         WHEN k < 13 THEN concat(' N', k, '.', i, '.H ')
         WHEN pos % 2 = 0 THEN concat('N', k, '.', i, ' (07.11)')
         ELSE concat('N', k, '.', i, '_(07.11)') END"""
OWN_NAME = """
    CASE WHEN pos % 31 = 0 THEN 'PCR neg'
         WHEN pos % 29 = 0 THEN concat('EX con ', pos)
         WHEN k < 13 THEN concat('n', k, '.', i, '.h')
         ELSE concat('n', k, '.', i, '  (07.11)') END"""
DISEASED = "CASE WHEN pos % 7 = 0 THEN NULL WHEN (k + i) % 2 = 0 THEN '0' ELSE '1' END"
GENUS = "concat(p_brand, '-', p_size)"
# The fifth kind has no description, the sixth one that no list names.
DESCRIPTION = """
    CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 'alga'
         ELSE element_at(array('fungus', 'coral', 'sponge', 'anemone'), p_size % 4 + 1) END"""


# Line items, or the cells they make, in one task of a shuffle. Adaptive execution goes by compressed bytes, of which a cell has
# seven: its 64 MB are nine million cells, and gigabytes once they are sorted, hashed or wide.
TASK_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def segments(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The market segments in order of name: what a sample column's number is counted in."""
    found = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().dropna().collect()
    return tuple(sorted(r[0] for r in found))


@lru_cache(maxsize=8)
def partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that the line items need, or None where one task can take them all. Parquet's footers have the count."""
    rows = table(spark, sf_dir, "lineitem").count()
    return max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism) if rows > TASK_ROWS else None


@lru_cache(maxsize=8)
def sample_count(spark: SparkSession, sf_dir: str) -> int:
    """Sample columns of a sheet: one per nation key and segment."""
    nations = table(spark, sf_dir, "nation").agg(F.max("n_nationkey") + 1).first()[0]
    return nations * len(segments(spark, sf_dir))


def _segment_array(spark: SparkSession, sf_dir: str) -> Column:
    return F.array(*[F.lit(s) for s in segments(spark, sf_dir)])


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation k, segment number i and pos of each sample."""
    n = len(segments(spark, sf_dir))
    return (
        table(spark, sf_dir, "nation")
        .select(
            F.col("n_nationkey").alias("k"),
            "n_regionkey",
            F.posexplode(_segment_array(spark, sf_dir)).alias("i", "segment"),
        )
        .selectExpr("k", "i", "n_regionkey", f"CAST(k * {n} + i + 1 AS BIGINT) AS pos")
    )


def sample_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw sample sheet with untidy names: pos, site, diseased, sample."""
    region = table(spark, sf_dir, "region").selectExpr("r_regionkey AS n_regionkey", "r_name AS site")
    return (
        _places(spark, sf_dir)
        .join(region, "n_regionkey")
        .selectExpr("pos", "site", f"{DISEASED} AS diseased", f"{SHEET_NAME} AS sample")
    )


def own_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column headers of the ITS2 sheet: marker, sample_pos, sample."""
    return _places(spark, sf_dir).selectExpr(
        "'ITS2' AS marker", "CAST(pos AS INT) AS sample_pos", f"{OWN_NAME} AS sample"
    )


def otus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTU headers; every 17th has one word only and so no species."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS otu",
        "p_partkey AS otu_pos",
        f"IF(p_partkey % 17 = 0, {GENUS}, concat({GENUS}, ' ', p_name)) AS header",
    )


def genus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description by genus."""
    return (
        table(spark, sf_dir, "part")
        .selectExpr(f"{GENUS} AS genus", f"{DESCRIPTION} AS description")
        .distinct()
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero cells of both sheets."""
    number = F.array_position(_segment_array(spark, sf_dir), F.col("c_mktsegment"))
    place = F.col("c_nationkey") * len(segments(spark, sf_dir)) + number
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), place.cast("int").alias("sample_pos")
    )
    placed = (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .selectExpr("o_orderkey AS l_orderkey", "sample_pos")
    )
    items, tasks = table(spark, sf_dir, "lineitem"), partitions(spark, sf_dir)
    if tasks is not None:
        items = items.repartition(tasks, "l_orderkey")
    found = items.join(placed, "l_orderkey").select(
        F.expr("IF(l_linestatus = 'O', 'ITS1', 'ITS2') AS marker"), F.col("l_partkey").alias("otu"), "sample_pos", "l_quantity"
    )
    if tasks is not None:
        found = found.repartition(tasks, "marker", "otu", "sample_pos")
    return (
        found.groupBy("marker", "otu", "sample_pos")
        .agg(F.sum("l_quantity").cast("long").alias("reads"))
        .select("marker", "otu", F.col("otu").alias("otu_pos"), "sample_pos", "reads")
    )


def study(spark: SparkSession, sf_dir: str) -> Study:
    sheet = sample_sheet(spark, sf_dir)
    return Study(
        cells=cells(spark, sf_dir),
        otus=otus(spark, sf_dir),
        names=naming.names_by_position(sheet, "ITS1").unionByName(
            naming.own_names(own_headers(spark, sf_dir))
        ),
        samples=cohort.sample_dimension(sheet, APPENDED_SAMPLES),
        genus_info=genus_info(spark, sf_dir),
    )


def _write_lines(frame: DataFrame, titles: Sequence[str], path: str) -> None:
    """frame as CSV under any titles, which Spark's writer refuses where they repeat: each file opens with them."""
    line = F.to_csv(F.struct(*frame.columns))
    header = frame.sparkSession.createDataFrame([tuple(titles)], [f"_{i}" for i in range(len(titles))])
    opening = header.select(F.to_csv(F.struct(*header.columns)).alias("value")).first()["value"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([opening])], ["value"])
        yield from batches

    frame.select(line.alias("value")).mapInArrow(opened, "value string").write.mode("overwrite").text(path)


def write_sheets(spark: SparkSession, sf_dir: str, path: str, fmt: str = "csv", blanks: Sequence[str] = ("PCR neg",)) -> None:
    """Writes the study as the sheets a user would export, CSV or Parquet: wide counts, samples, genera.

    Rows stand in order of OTU, spread over range-partitioned files. Attributes take the first 27
    columns of a count sheet. ITS1 columns carry names of no meaning, since position names them. In a CSV all blanks
    of ITS2 have one title, or take turns with those of ``blanks``; Parquet has no repeated names, so there their
    place is appended.
    """
    own = [r["sample"] for r in own_headers(spark, sf_dir).orderBy("sample_pos").collect()]
    columns, tasks = sample_count(spark, sf_dir), partitions(spark, sf_dir)
    turn = cycle(blanks)
    titles = {
        "ITS1": [f"column {p}" for p in range(1, columns + 1)],
        "ITS2": [
            n if n != "PCR neg" else next(turn) if fmt == "csv" else f"{n} at {p}" for p, n in enumerate(own, start=1)
        ],
    }
    attributes = [f"attribute {i}" for i in range(4, 28)]
    for marker, names in titles.items():
        here = cells(spark, sf_dir).filter(F.col("marker") == marker)
        wide = widen(here, ["otu"], range(1, columns + 1), tasks)
        named = wide.join(otus(spark, sf_dir).select("otu", "header"), "otu")
        rows = (
            (named.repartitionByRange("otu") if tasks is None else named.repartitionByRange(tasks, "otu"))
            .sortWithinPartitions("otu")
            .select(
                F.col("otu").alias("OTU"),
                "header",
                F.lit("").alias("spread"),
                *[F.lit(None).cast("string").alias(a) for a in attributes],
                *[F.col(str(p)).alias(f"_{p}") for p in range(1, columns + 1)],
            )
        )
        every = ["OTU", "header", "spread", *attributes, *names]
        if fmt == "csv":
            _write_lines(rows, every, f"{path}/{marker}")
        else:
            rows.toDF(*every).write.mode("overwrite").save(f"{path}/{marker}", format=fmt)
    (
        sample_sheet(spark, sf_dir)
        .repartitionByRange("pos")
        .sortWithinPartitions("pos")
        .select("site", "diseased", "sample")
        .write.mode("overwrite")
        .save(f"{path}/samples", format=fmt, header=True)
    )
    genus_info(spark, sf_dir).write.mode("overwrite").save(f"{path}/genera", format=fmt, header=True)


def study_from_files(spark: SparkSession, path: str, fmt: str = "csv") -> Study:
    """The study read back from the sheets of ``write_sheets``. CSV is landed beside them."""
    return sheets.study_from_sheets(
        sheets.read_abundance_sheet(spark, f"{path}/ITS1", "ITS1", fmt, landing=f"{path}/landed/ITS1"),
        sheets.read_abundance_sheet(spark, f"{path}/ITS2", "ITS2", fmt, landing=f"{path}/landed/ITS2"),
        sheets.read_sample_sheet(spark, f"{path}/samples", fmt, landing=f"{path}/landed/samples"),
        sheets.read_genus_lookup(spark, f"{path}/genera", fmt),
        APPENDED_SAMPLES,
    )
