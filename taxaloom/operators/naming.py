"""Names of the sample columns of a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.functions import text


def number_blanks(names: DataFrame) -> DataFrame:
    """Gives repeated blank names a running number per marker, in column order."""
    is_blank = F.lower("sample").contains(model.BLANK_MARK)
    order = W.partitionBy("marker", is_blank).orderBy("sample_pos")
    numbered = F.concat(F.lit(model.BLANK_PREFIX), F.row_number().over(order).cast("string"))
    return names.withColumn("sample", F.when(is_blank, numbered).otherwise(F.col("sample")))


def own_names(headers: DataFrame) -> DataFrame:
    """Names taken from a sheet's own column headers: blanks numbered, then cleaned."""
    return number_blanks(headers).withColumn(
        "sample", text.clean_name(F.col("sample"), model.OWN_NAME_RULES)
    )


def names_by_position(sheet: DataFrame, marker: str) -> DataFrame:
    """Names taken from the row order of the sample sheet, whatever the columns are called."""
    return sheet.select(
        F.lit(marker).alias("marker"),
        F.col("pos").cast("int").alias("sample_pos"),
        text.clean_name(F.col("sample"), model.SHEET_NAME_RULES).alias("sample"),
    )
