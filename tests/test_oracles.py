"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from mendwell.plans.catalog import QUERIES
from mendwell.plans.oracles import ORACLES

WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, plan, name):
    df = QUERIES[name](spark, sf_dir)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert differences(df, con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
