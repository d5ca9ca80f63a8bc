"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sluice.registered import INCREMENTAL, ORACLE_SQL, OTHERS, QUERIES, TEXTS

from .oracle import compare, connect

MAY_BE_EMPTY = {"aggregate_empty"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", TEXTS)
def test_batch(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["inc_join_aggregate", "inc_left_join", "inc_pull", "inc_pull_star", *OTHERS])
def test_incremental(spark, sf, con, name):
    assert name in INCREMENTAL or name in OTHERS
    assert compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, sf):
    plan = QUERIES["where_compare"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # keyed rows need no deduplication
    read = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "o_totalprice" in read and "o_custkey" not in read


def test_join_on_key_needs_no_distinct(spark, sf):
    plan = QUERIES["join_inner"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
