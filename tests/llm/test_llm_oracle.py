"""Every query of the subpackage with an SQL equivalent agrees with DuckDB on whole tables."""

from __future__ import annotations

import os

import compare
import pytest

from corpuscope.llm.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    run, sql = QUERIES[name]
    assert compare.difference(run(spark, FOLDER), compare.connect(FOLDER), sql) is None
