from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from compare import connect, difference

SF_DIR = entry_point.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(entry_point.core_queries()) == set(entry_point.SQL)


@pytest.mark.parametrize("name", list(entry_point.core_queries()))
def test_query_equals_its_sql(spark, con, name):
    result = entry_point.core_queries()[name](spark, SF_DIR)
    assert difference(con, entry_point.SQL[name], result) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() == 760
