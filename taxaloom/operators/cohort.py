"""The sample dimension: status, dataset, controls, group sizes and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.functions import numbers, text


def append_sample(sheet: DataFrame, name: str) -> DataFrame:
    """The sheet with one more row at its end: a name without site and status."""
    last = sheet.agg((F.max("pos") + 1).alias("pos")).select(
        "pos",
        F.lit(None).cast("string").alias("site"),
        F.lit(None).cast("string").alias("diseased"),
        F.lit(name).alias("sample"),
    )
    return sheet.unionByName(last)


def split_datasets(samples: DataFrame) -> DataFrame:
    """Adds dataset: 'extra' from the first row whose name is marked, 'original' before it.

    Later rows belong to 'extra' whether or not they are marked themselves. The first position is a
    scalar subquery, so no window has to bring all samples together.
    """
    split = samples.agg(
        F.min(F.when(F.col("sample").contains(model.EXTRA_MARK), F.col("pos")))
    ).scalar()
    is_extra = F.coalesce(F.col("pos") >= split, F.lit(False))
    return samples.withColumn(
        "dataset", F.when(is_extra, model.EXTRA).otherwise(model.ORIGINAL)
    )


def sample_dimension(sheet: DataFrame, appended: Sequence[str] = ()) -> DataFrame:
    """pos, site, diseased, sample, dataset, status, is_control from a raw sample sheet."""
    for name in appended:
        sheet = append_sample(sheet, name)
    cleaned = sheet.select(
        "pos",
        text.title_case(F.col("site")).alias("site"),
        numbers.status_code(F.col("diseased")).alias("diseased"),
        text.clean_name(F.col("sample"), model.SHEET_NAME_RULES).alias("sample"),
    )
    return split_datasets(cleaned).withColumns(
        {
            "status": text.label(F.col("diseased"), model.STATUS_LABELS),
            "is_control": text.contains_any(F.col("sample"), model.CONTROL_MARKS),
        }
    )


def group_sizes(samples: DataFrame) -> DataFrame:
    """Samples per dataset and status code."""
    return samples.groupBy("dataset", "diseased", "status").agg(
        F.count("*").alias("total_samples")
    )


def status_totals(samples: DataFrame) -> DataFrame:
    """One row per dataset with its healthy and its sick samples: never more than two rows."""
    return samples.groupBy("dataset").agg(
        F.count_if(F.col("status") == "healthy").alias("healthy_total"),
        F.count_if(F.col("status") == "sick").alias("sick_total"),
    )


def sheet_columns(names: DataFrame, samples: DataFrame) -> DataFrame:
    """The sample columns of every sheet with the attributes of their samples."""
    return names.join(samples, "sample", "left")


def panel_columns(
    columns: DataFrame, panels: Sequence[tuple[str, str]] = model.PANELS
) -> DataFrame:
    """The columns of each PCA panel, without controls, numbered from 0 in sheet order.

    A column belongs to a panel if its name is one of the panel's dataset and no control; a name
    missing from the sample sheet has no dataset and falls out.
    """
    number = F.lit(None).cast("int")
    for i, (marker, dataset) in enumerate(panels, start=1):
        here = (F.col("marker") == marker) & (F.col("dataset") == dataset)
        number = F.when(here, i).otherwise(number)
    order = W.partitionBy("panel").orderBy("sample_pos")
    return (
        columns.filter(~F.col("is_control"))
        .withColumn("panel", number)
        .filter("panel IS NOT NULL")
        .withColumn("sample_idx", F.row_number().over(order) - 1)
    )
