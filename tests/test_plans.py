"""Properties of physical plans that must hold at any scale."""

from __future__ import annotations

from functools import lru_cache

import pytest

import __spark_entry__ as entry_point
from taxaloom.functions import sizing
from taxaloom.plans import overview
from taxaloom.sources import testtables

QUERIES = list(entry_point.core_queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@lru_cache(maxsize=None)
def _plan_of(spark, name: str) -> str:
    """The plan of a query, built once: some write sheets or tables first."""
    return _plan(entry_point.core_queries()[name](spark, entry_point.SMOKE_DIR))


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_joins_and_no_row_python(spark, name):
    plan = _plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize("name", QUERIES)
def test_windows_are_partitioned(spark, name):
    plan = _plan_of(spark, name)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("SinglePartition" in below for below in lines[i + 1 : i + 3]), line


def test_scans_read_needed_columns_only(spark):
    plan = _plan(entry_point.queries()["prevalence_genus"](spark, entry_point.SMOKE_DIR))
    scan = next(line for line in plan.splitlines() if "FileScan parquet [l_" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_linestatus:string>" in scan
    assert "IsNotNull(l_orderkey)" in scan


def test_marker_filter_reaches_the_scan(spark):
    cells = testtables.cells(spark, entry_point.SMOKE_DIR).filter("otu = 5")
    scan = next(line for line in _plan(cells).splitlines() if "FileScan parquet [l_" in line)
    assert "EqualTo(l_partkey,5)" in scan


def test_samples_beyond_the_bound_join_by_shuffle(spark, monkeypatch):
    small = overview.overview_by_taxon(testtables.study(spark, entry_point.SMOKE_DIR), "genus")
    expected = sorted(map(str, small.collect()))
    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (0,))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        study = testtables.study(spark, entry_point.SMOKE_DIR)
        large = overview.presence_by(study, "genus")
        assert "BroadcastHashJoin" not in _plan(large).split("InMemoryRelation")[0]
        again = overview.overview_by_taxon(study, "genus")
        assert sorted(map(str, again.collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
