"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry_points
from vecfold.plans.oracle import SQL
from vecfold.plans.registry import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"search_codes", "search_ivf_probes"}


def test_entry_points_offer_all_queries():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    assert compare(QUERIES[name](spark, sf_dir), connection, SQL[name]) is None
