"""Every registered query with SQL gives the same rows in DuckDB, on whole tables of the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tools import check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert check.compare(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 11
