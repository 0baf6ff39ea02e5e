"""Every registered query against its SQL. Set VECTRAIL_SF to compare at another scale."""

import os

import pytest

import __spark_entry__ as entry

from vectrail.plans import QUERIES as PLANS

from .compare import database, spark_rows, sql_rows

SF_DIR = f"/root/testdata/sf{os.environ.get('VECTRAIL_SF', '0.001')}"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(SQL) & set(PLANS)))
def test_query_matches_sql(spark, duck, name):
    got, columns = spark_rows(QUERIES[name](spark, SF_DIR))
    want, sql_columns = sql_rows(duck, SQL[name])
    assert columns == sql_columns
    assert got == want


def test_every_query_has_sql():
    assert set(PLANS) == set(SQL) & set(PLANS)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
