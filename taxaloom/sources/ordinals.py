"""The row order of files as an explicit column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaloom.functions.sizing import MAX_BROADCAST_BYTES, ROW_OVERHEAD

PIECE = ["_path", "_start"]
PIECES_PER_GROUP = 1024
PIECE_BYTES = ROW_OVERHEAD + 16 + 3 * 8  # of a row of shifts beside its path


def file_number(path: Column) -> Column:
    """The number in a part file's name. Names compare as text, numbers do not: part-100000 follows part-99999."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("long")


def _placed(scan: DataFrame, fmt: str, landing: str | None) -> DataFrame:
    """The rows with the piece of input they come from and a number that rises within it.

    Parquet knows the place of a row in its file. Text does not: its rows are known by split and order
    of reading, and how Spark splits files depends on the executors it has at the time. So text is
    written once with its places to the folder the caller names, and everything after reads that table.
    """
    path = F.col("_metadata.file_path").alias("_path")
    if fmt == "parquet":
        row = F.col("_metadata.row_index").alias("_id")
        return scan.select("*", path, F.lit(0).cast("long").alias("_start"), row)
    if landing is None:
        raise ValueError("text files need a landing folder, or a column that numbers their rows")
    start = F.col("_metadata.file_block_start").alias("_start")
    placed = scan.select("*", path, start, F.monotonically_increasing_id().alias("_id"))
    placed.write.mode("overwrite").parquet(landing)
    return scan.sparkSession.read.schema(placed.schema).parquet(landing)


def with_row_number(
    scan: DataFrame,
    name: str,
    fmt: str = "csv",
    per: Sequence[str] = (),
    landing: str | None = None,
) -> DataFrame:
    """Numbers the rows of a file scan from 1, by file number, path and line, per partition value if asked.

    ``scan`` is a file reader's frame, or columns of one. Rows of one piece (a Parquet file, or a split
    of a text file) are numbered by their place in it, shifted by the rows of the pieces ahead: those of its
    group of pieces by a window per group, those of the groups ahead by one number per group. No data row is
    shuffled or sorted. Text is landed first, in the folder ``landing``, which the caller owns and removes.
    """
    placed = _placed(scan, fmt, landing)
    number = F.coalesce(file_number(F.col("_path")), F.lit(-1))
    pieces = (
        placed.groupBy(*per, *PIECE)
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .withColumn("_file", number)
        .withColumn("_group", F.floor(F.col("_file") / PIECES_PER_GROUP))
    )
    # A number per 1,024 files comes to the driver, which lists the files anyway, and goes back as a table of that size.
    sums: dict[tuple, dict[int, int]] = {}
    size = 0  # of the shifts, measured along with the sums
    width = F.sum(F.octet_length("_path") + PIECE_BYTES)
    for row in pieces.groupBy(*per, "_group").agg(F.sum("_n").alias("n"), width.alias("size")).collect():
        sums.setdefault(tuple(row[: len(per)]), {})[row["_group"]] = row["n"]
        size += row["size"]
    bases = []
    for key, groups in sums.items():
        total = 0
        for group in sorted(groups):
            bases.append((*key, group, total))
            total += groups[group]
    types = T.StructType([*pieces.select(*per, "_group").schema.fields, T.StructField("_base", T.LongType())])
    base = scan.sparkSession.createDataFrame(bases, types)
    base = base.select(*(F.col(c).alias(f"_of_{c}") for c in (*per, "_group")), "_base")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*per, "_group")]
    within = W.partitionBy(*per, "_group").orderBy("_file", *PIECE).rowsBetween(W.unboundedPreceding, -1)
    inside = pieces.withColumn("_ahead", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    ahead = F.col("_ahead") + F.col("_base")
    shifts = inside.join(F.broadcast(base), same).select(*PIECE, "_first", ahead.alias("_shift"))
    number = F.col("_id") - F.col("_first") + F.col("_shift") + 1
    shifts = F.broadcast(shifts) if size <= MAX_BROADCAST_BYTES else shifts
    return placed.join(shifts, PIECE).select(*scan.columns, number.alias(name))
