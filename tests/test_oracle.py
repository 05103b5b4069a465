"""Every registered query against its SQL in DuckDB on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from ledgerlight import catalog
from oracle import check
from oracle.sql import SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables missing")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    _, problem = check.compare(spark, duck, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert not problem
