"""Results stay readable while, and after, their replacement fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from study_fixture import make_study, rows
from taxaloom.plans import overview, report
from taxaloom.sinks.replace import recover, replace
from taxaloom.sinks.report import write_report
from taxaloom.sinks.tables import write_overviews


def broken(df, column, value):
    """The rows of df, of which one fails when it is written."""
    refused = F.raise_error(F.lit("lost")).cast("string")
    return df.withColumn(column, F.when(F.col(column) == value, refused).otherwise(F.col(column)))


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_a_failed_write_leaves_the_old_tables(spark, tmp_path):
    target = tmp_path / "overview"
    table = overview.overview_by_taxon(make_study(spark), "genus")
    write_overviews(table, str(target))
    before = rows(spark.read.parquet(str(target)))
    with pytest.raises(Exception, match="lost"):
        write_overviews(broken(table, "taxon", "Alternaria"), str(target))
    assert rows(spark.read.parquet(str(target))) == before
    assert names(tmp_path) == ["overview"]
    write_overviews(table.filter("taxon = 'Alternaria'"), str(target))
    assert 0 < spark.read.parquet(str(target)).count() < len(before)
    assert names(tmp_path) == ["overview"]


def test_a_failed_write_leaves_the_old_report(spark, tmp_path):
    target = tmp_path / "report"
    lines = report.report_lines(make_study(spark))
    write_report(lines, str(target))
    before = rows(spark.read.text(str(target)))
    with pytest.raises(Exception, match="lost"):
        write_report(broken(lines, "text", "### s2.h"), str(target))
    assert rows(spark.read.text(str(target))) == before
    assert names(tmp_path) == ["report"]


def test_the_old_folder_stands_until_the_new_one_is_whole(spark, tmp_path):
    target = tmp_path / "t"
    target.mkdir()
    (target / "old").write_text("")
    seen = []

    def write(path):
        seen.extend(names(target))
        spark.range(3).write.parquet(path)

    replace(spark, f"{target}/", write)
    assert seen == ["old"]
    assert spark.read.parquet(str(target)).count() == 3
    assert names(tmp_path) == ["t"]


def test_results_set_aside_come_back(spark, tmp_path):
    """What a driver leaves that is lost between the two renames."""
    target = tmp_path / "t"
    assert not recover(spark, str(target))
    spark.range(5).write.parquet(str(tmp_path / "_t.old-1"))
    spark.range(9).write.parquet(str(tmp_path / "_t.new-1"))
    assert recover(spark, str(target))
    assert spark.read.parquet(str(target)).count() == 5
    assert not recover(spark, str(target))
    with pytest.raises(ZeroDivisionError):
        replace(spark, str(target), lambda path: 1 / 0)
    assert spark.read.parquet(str(target)).count() == 5
