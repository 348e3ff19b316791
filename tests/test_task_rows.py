"""Tables beyond one task's rows: the same cells and sheets, with a bounded number of rows in each task."""

from __future__ import annotations

import re

import pytest

from taxaloom.operators import reshape
from taxaloom.sources import testtables


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """Tables with null and repeated keys, and more line items than one task takes."""
    monkeypatch.setattr(testtables, "TASK_ROWS", 16)
    frames = {
        "nation": ([(k, k % 2) for k in range(3)], "n_nationkey int, n_regionkey int"),
        "customer": ([(i, i % 3, "ab"[i % 2]) for i in range(9)] + [(None, 1, "a"), (8, 2, "a")], testtables.SCHEMAS["customer"]),
        "orders": ([(i, i % 9) for i in range(40)] + [(None, 1), (7, None), (7, 3)], testtables.SCHEMAS["orders"]),
        "lineitem": (
            [(i % 41, i % 13 or None, float(i % 7), "OF"[i % 2]) for i in range(200)] + [(None, 1, 1.0, "O"), (3, 2, None, "O"), (3, 2, 1.0, None)],
            testtables.SCHEMAS["lineitem"],
        ),
        "part": ([(i, f"name {i}", "Brand", i) for i in range(1, 13)], testtables.SCHEMAS["part"]),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_of_an_id_are_made_in_one_task(spark):
    cells = spark.createDataFrame([(i % 50, 1 + i % 3, i) for i in range(400)] + [(None, 2, 5), (7, None, 4)], "otu long, sample_pos int, reads long")
    wide = reshape.widen(cells, ["otu"], range(1, 4), partitions=5)
    assert re.findall(r"Exchange hashpartitioning\(otu[^,]*, (\d+)\)", plan(wide)) == ["5"]
    assert plan(wide).count("Exchange hashpartitioning") == 1
    assert sorted(wide.collect(), key=str) == sorted(reshape.widen(cells, ["otu"], range(1, 4)).collect(), key=str)


def test_cells_beyond_one_task_are_the_same(spark, tables, monkeypatch):
    assert testtables.partitions(spark, tables) == 13  # 203 line items, 16 a task
    found = testtables.cells(spark, tables)
    assert re.findall(r"Exchange hashpartitioning\(marker[^)]*, (\d+)\)", plan(found)) == ["13"]
    assert found.rdd.getNumPartitions() == 13
    rows = sorted(found.collect(), key=str)
    monkeypatch.setattr(testtables, "partitions", lambda *_: None)
    assert rows and rows == sorted(testtables.cells(spark, tables).collect(), key=str)


def test_sheets_beyond_one_task_have_the_same_rows_in_order(spark, tables, tmp_path, monkeypatch):
    def written(path: str) -> list:
        for fmt in ("csv", "parquet"):
            testtables.write_sheets(spark, tables, f"{path}/{fmt}", fmt)
        return [
            [r[:1] + r[27:] for r in spark.read.parquet(f"{path}/parquet/{m}").orderBy("OTU").collect()] for m in ("ITS1", "ITS2")
        ]

    spark.createDataFrame([(0, "reef"), (1, "bay")], testtables.SCHEMAS["region"]).write.parquet(f"{tables}/region.parquet")
    large = written(str(tmp_path / "large"))
    monkeypatch.setattr(testtables, "partitions", lambda *_: None)
    assert all(large) and large == written(str(tmp_path / "small"))
