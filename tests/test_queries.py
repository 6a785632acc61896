"""Every registered query equals its DuckDB oracle (sf0.001 in the suite)."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
_Q = E.queries()
_O = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(_O))
def test_query_matches_oracle(spark, con, key):
    df = _Q[key](spark, SF)
    assert compare(df, con, _O[key]) == []


@pytest.mark.parametrize("key", sorted(set(_Q) - set(_O)))
def test_query_runs(spark, key):
    df = _Q[key](spark, SF)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
