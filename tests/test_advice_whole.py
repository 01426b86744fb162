"""The _all queries answer every row, and agree with the named subsets on those."""

import pytest

from chronoterra import queries as core

from .oracle import SMALL

SUBSETS = {
    "contents_at_changeset": "feature_id % 100 = 0",
    "related_features": "(direction = 'forward' AND feature_id <= 40) OR (direction = 'backward' AND related <= 40)",
    "schema_errors": "field <> 'owner' OR feature_id % 50 = 0",
}


@pytest.mark.parametrize("name", sorted(SUBSETS))
def test_whole_query_holds_the_subset(spark, name):
    whole, part = core.QUERIES[f"{name}_all"](spark, SMALL), core.QUERIES[name](spark, SMALL)
    assert whole.count() > part.count()
    assert sorted(map(tuple, whole.filter(SUBSETS[name]).collect())) == sorted(map(tuple, part.collect()))


def test_every_order_has_contents(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert core.QUERIES["contents_at_changeset_all"](spark, SMALL).select("feature_id").distinct().count() == orders


@pytest.mark.parametrize("name", ["shortest_paths", "service_area", "network_components", "network_trace", "visible_datasets", "access_levels"])
def test_sql_of_the_whole_has_no_bound(name):
    part, whole = core.ORACLE_SQL[name], core.ORACLE_SQL[f"{name}_all"]
    assert whole != part and not any(x in whole for x in ("<= 3 GROUP", "% 97", "% 13"))
