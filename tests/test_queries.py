"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import connect, differences
from textguard.plans.registry import entries

# queries of the llm subpackage have tests of their own
QUERIES = {n: q for n, (q, _) in entries().items()}
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_all_have_sql():
    assert not set(QUERIES) - set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    diff, _ = differences(QUERIES[name](spark, sf), con, SQL[name])
    assert diff == ""
