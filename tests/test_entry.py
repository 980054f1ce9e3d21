"""The driver's contract, and every oracle on the smallest data."""

import pytest

import __spark_entry__ as entry
from quercus.plans.catalogue import QUERIES
from quercus.plans.oracle import SQL
from tests.oracle import compare, connect


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["name_a", "rang", "name_b", "gesamt"]
    assert df.count() >= 0


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, data, con, name):
    assert compare(QUERIES[name](spark, data), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
