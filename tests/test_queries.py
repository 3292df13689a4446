"""Registered queries of the core against their SQL on the smallest tables."""

import pytest
from compare import against_sql
from conftest import SMALL

from strata.plans import core, reference

QUERIES = core.QUERIES | reference.QUERIES
SQL = core.ORACLES | reference.ORACLES


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want, a, b = against_sql(spark, con, name, QUERIES[name], SQL[name], SMALL)
    assert a == b
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))
