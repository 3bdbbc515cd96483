"""Every query with SQL gives the same table in Spark and in DuckDB; the others give rows."""

from __future__ import annotations

import pytest
from compare import differences, duck

from motorspark import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(spark, connection, name):
    assert differences(catalog.QUERIES[name](spark, SF_DIR), connection, oracle.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(catalog.QUERIES)
