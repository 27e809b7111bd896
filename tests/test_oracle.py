"""Every registered query with an SQL equivalent agrees with DuckDB on whole tables."""

from __future__ import annotations

import os

import compare
import pytest

from corpuscope.queries.registry import registered

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLE = registered()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, (_, sql) in TABLE.items() if sql])
def test_matches_sql(spark, con, name):
    run, sql = TABLE[name]
    assert compare.difference(run(spark, FOLDER), con, sql) is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in TABLE.items() if not sql])
def test_runs(spark, name):
    assert TABLE[name][0](spark, FOLDER).count() > 0
