"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, tables.execute(entry.oracle_sql()[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "id", "freq"]
