"""The queries that SQL can express, next to DuckDB."""

from __future__ import annotations

import os

import pytest

from compare import connect, difference
from taxaloom.llm import queries

SF_DIR = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    found = connect(SF_DIR)
    for table in ("documents", "pages", "conversations"):
        path = f"{SF_DIR}/{table}.parquet"
        if os.path.isdir(path):
            found.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return found


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert difference(con, queries.oracle_sql()[name], queries.queries()[name](spark, SF_DIR)) is None
