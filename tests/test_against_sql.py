"""Every registered query with SQL, value by value against DuckDB on the smallest tables."""

import pytest

import catalog
from tests.compare import TESTDATA, compare, connect

SMALLEST = str(TESTDATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    problem, _, _ = compare(spark, connect(SMALLEST), name, SMALLEST)
    assert problem == ""


def test_sql_only_for_registered_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
