"""Wide sheets to long cells and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(wide: DataFrame, ids: Sequence[str], sample_columns: Sequence[str]) -> DataFrame:
    """One row per id and sample column, zero and NULL cells included, with sample_pos from 1.

    Exploding an array keeps the generated code small. ``unpivot`` writes one branch per column,
    which at 170 columns leaves compiled code and takes about twice as long.
    """
    cells = F.array(*[F.col(f"`{c}`") for c in sample_columns])
    return melt_array(wide, ids, cells)


def melt_array(wide: DataFrame, ids: Sequence[str], cells: Column) -> DataFrame:
    """The same for cells that are one array already."""
    return wide.select(*ids, F.posexplode(cells).alias("_at", "reads")).select(
        *ids, (F.col("_at") + 1).alias("sample_pos"), "reads"
    )


def widen(cells: DataFrame, ids: Sequence[str], positions: Sequence[int], partitions: int | None = None) -> DataFrame:
    """One row per id and one column per sample position, 0 for missing cells.

    Positions are given, so the schema does not depend on the data. With ``partitions`` all cells of an id are dealt to one of
    so many tasks, which holds the wide rows of its own ids only. Without it every task holds wide rows of nearly all ids, and
    adaptive execution makes few tasks, since it goes by the size of the narrow cells.
    """
    if partitions is not None:
        cells = cells.repartition(partitions, *ids)
    wide = cells.groupBy(*ids).pivot("sample_pos", list(positions)).agg(F.sum("reads"))
    return wide.na.fill(0, [str(p) for p in positions])


def picked(counts: Column, positions: Sequence[int]) -> Column:
    """The counts at the given positions (from 1) as doubles, blank cells as 0."""
    places = F.array(*[F.lit(p) for p in positions])
    return F.transform(places, lambda p: F.coalesce(F.get(counts, p - 1), F.lit(0)).cast("double"))


def sparse_rows(cells: DataFrame) -> DataFrame:
    """One row per panel and OTU: the sample_idx and reads of its cells.

    A row holds at most one entry per sample of the panel. It is keyed by the OTU's row in the sheet,
    so a repeated id stays two rows.
    """
    entry = F.struct("sample_idx", "reads")
    return (
        cells.groupBy("panel", "otu_pos")
        .agg(F.collect_list(entry).alias("entries"))
        .select(
            "panel",
            "otu_pos",
            F.col("entries.sample_idx").alias("idx"),
            F.col("entries.reads").cast("array<double>").alias("val"),
        )
    )


def dense_rows(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """panel, values from sparse rows: the entries in place, with runs of zeros between them."""
    n = F.lit(None).cast("int")
    for panel, size in sizes.items():
        n = F.when(F.col("panel") == panel, F.lit(size)).otherwise(n)
    zeros = lambda times: F.array_repeat(F.lit(0.0), times)
    entries = F.array_sort(F.arrays_zip("idx", "val"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.col("entries")[i - 1]["idx"])
    placed = F.transform("entries", lambda e, i: F.concat(zeros(e["idx"] - before(i) - 1), F.array(e["val"])))
    last = F.element_at("entries", -1)["idx"]
    return (
        rows.withColumn("entries", entries)
        .withColumn("runs", F.concat(placed, F.array(zeros(n - last - 1))))
        .select("panel", F.flatten("runs").alias("values"))
    )
