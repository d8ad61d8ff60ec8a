"""Every registered query beside its oracle SQL on the smallest tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = "0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note
