"""Every registered query against its SQL."""

import pytest
from compare import compare, database

import __spark_entry__ as entry
from stocklens.plans import oracle, registry

QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
