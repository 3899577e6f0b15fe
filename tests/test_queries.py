"""Every registered query against its SQL on the smallest tables, and the shape of the contract."""

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return oracle.connect("0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    ok, note = oracle.compare(spark, tables, name, QUERIES[name], ORACLES.get(name), "0.001")
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
