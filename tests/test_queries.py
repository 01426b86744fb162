"""Every registered query of the engine itself against its SQL."""

import pytest

from chronoterra import queries as core

from .oracle import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(core.QUERIES[name](spark, SMALL), core.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_orders_of_every_status_are_edges(spark):
    read = lambda name, c: {r[0] for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(c).collect()}
    got = {r.id for r in core.QUERIES["isolated_junctions"](spark, SMALL).collect()}
    assert got == read("customer", "c_custkey") - read("orders", "o_custkey")
