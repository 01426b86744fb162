"""Writes to the log: what updates inherit, merge parents, valid times."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoterra.operators import commits, history, merging, snapshot

LOG = "version_id long, feature_id long, changeset_id long, operation string, properties string, lng double, lat double, created_at long, valid_from timestamp, valid_to timestamp"
GRAPH = "id long, parent_id long, merge_parent_id long, branch string, created_at long"
DAY = [datetime(2024, 1, d) for d in range(1, 10)]


@pytest.fixture
def state(spark):
    log = spark.createDataFrame([
        (1, 1, 1, "insert", '{"a":1}', 10.0, 20.0, 1, DAY[0], None),
        (2, 2, 1, "insert", '{"a":2}', 11.0, 21.0, 1, None, DAY[5]),
        (3, 1, 2, "update", '{"a":3}', 12.0, 22.0, 2, DAY[1], DAY[2]),
        (4, 2, 2, "delete", "{}", None, None, 2, None, None),
        (5, 1, 3, "update", '{"a":4}', 13.0, 23.0, 3, None, None),
    ], LOG)
    graph = spark.createDataFrame([(1, None, None, "main", 1), (2, 1, None, "main", 2), (3, 1, None, "other", 3)], GRAPH)
    return log, graph, spark.createDataFrame([("main", 2), ("other", 3), ("empty", None)], "name string, head long")


def row(df, feature_id):
    r = df.filter(F.col("feature_id") == feature_id).first()
    return r.properties, r.lng, r.lat, r.valid_from, r.valid_to


def test_updates_inherit_from_their_own_branch(spark, state):
    props = spark.createDataFrame([(1, "update", '{"b":1}')], "feature_id long, operation string, properties string")
    rows, _, _ = commits.commit(*state, "main", props, 9, 9)
    assert row(rows, 1) == ('{"b":1}', 12.0, 22.0, DAY[1], DAY[2])  # not what the other branch has
    place = spark.createDataFrame([(1, "update", 1.0, 2.0, None, DAY[7])], "feature_id long, operation string, lng double, lat double, valid_from timestamp, valid_to timestamp")
    rows, _, _ = commits.commit(*state, "main", place, 9, 9)
    assert row(rows, 1) == ('{"a":3}', 1.0, 2.0, None, DAY[7])  # one given time counts as given


def test_inheritance_takes_the_newest_version_that_is_no_delete(spark, state):
    change = spark.createDataFrame([(2, "update")], "feature_id long, operation string")
    with pytest.raises(ValueError, match="update of feature 2"):
        commits.commit(*state, "main", change, 9, 9)
    rows, _, _ = commits.push(*state, "main", 2, change, 9, 9)  # a batch isn't validated
    assert row(rows, 2) == ('{"a":2}', 11.0, 21.0, None, DAY[5])
    with pytest.raises(ValueError, match="inherit"):
        commits.push(*state, "main", 2, spark.createDataFrame([(7, "update")], "feature_id long, operation string"), 9, 9)


def test_inserts_and_deletes_inherit_nothing(spark, state):
    changes = spark.createDataFrame([(1, "delete", "{}"), (2, "insert", None), (3, "insert", "{}")], "feature_id long, operation string, properties string")
    rows, fresh, moved = commits.commit(*state, "main", changes, 9, 9)
    assert row(rows, 1)[1:] == (None,) * 4 and row(rows, 2) == (None,) * 5
    assert fresh.first().merge_parent_id is None and {r.name: r.head for r in moved.collect()}["main"] == 9
    first = spark.createDataFrame([(5, "insert", 1.0)], "feature_id long, operation string, lng double")
    rows, fresh, _ = commits.commit(*state, "empty", first, 9, 9)
    assert rows.count() == 1 and fresh.first().parent_id is None


def test_a_second_merge_starts_at_the_first(spark, state):
    log, graph, heads = state
    # the sides differ in feature 1's place and times; settle by keeping main away from it
    graph = graph.filter("id <> 2")
    log = log.filter("changeset_id <> 2")
    heads = spark.createDataFrame([("main", 1), ("other", 3)], "name string, head long")
    mine = spark.createDataFrame([(9, "insert", "{}", 0.0, 0.0)], "feature_id long, operation string, properties string, lng double, lat double")
    rows, fresh, heads = commits.commit(log, graph, heads, "main", mine, 4, 4)
    log, graph = log.union(rows), graph.union(fresh)
    rows, fresh, heads = merging.merge_commit(log, graph, heads, "main", "other", 5, 5)
    assert [r.feature_id for r in rows.collect()] == [1] and row(rows, 1) == ('{"a":4}', 13.0, 23.0, None, None)
    assert (fresh.first().parent_id, fresh.first().merge_parent_id) == (4, 3)
    log, graph = log.union(rows), graph.union(fresh)
    assert history.merge_base(graph, 5, 3).first().id == 3
    again = merging.merge_commit(log, graph, heads, "main", "other", 6, 6)
    assert again[0].count() == again[1].count() == 0
    rows, fresh, heads = commits.commit(log, graph, heads, "other", spark.createDataFrame([(2, "delete")], "feature_id long, operation string"), 6, 6)
    log, graph = log.union(rows), graph.union(fresh)
    rows, _, heads = merging.merge_commit(log, graph, heads, "main", "other", 7, 7)
    assert [(r.feature_id, r.operation) for r in rows.collect()] == [(2, "delete")]


def test_valid_times_are_content_of_a_merge(spark, state):
    _, graph, _ = state
    time = lambda v, c, lo, hi: (v, 1, c, "insert" if c == 1 else "update", '{"a":1}', 0.0, 0.0, c, lo, hi)
    log = spark.createDataFrame([time(1, 1, DAY[0], DAY[8]), time(2, 2, DAY[1], DAY[8]), time(3, 3, DAY[0], DAY[5])], LOG)
    got = merging.merge_choices(log, graph, 2, 3).first()
    assert (got.choice, got.valid_from, got.valid_to) == ("merged", DAY[1], DAY[5])
    clash = spark.createDataFrame([time(1, 1, DAY[0], None), time(2, 2, DAY[1], None), time(3, 3, DAY[2], None)], LOG)
    assert merging.merge_choices(clash, graph, 2, 3).first().choice == "property_conflict"
    how = spark.createDataFrame([(1, "theirs")], "feature_id long, strategy string")
    assert row(merging.resolve_and_merge(clash, graph, 2, 3, how, 9, 9), 1)[3] == DAY[2]


def test_only_the_changed_features_are_resolved(spark, state):
    change = spark.createDataFrame([(1, "update", 5.0)], "feature_id long, operation string, lng double")
    part = commits.of_features(state[0], change)
    assert {r.feature_id for r in part.collect()} == {1}
    assert "BroadcastHashJoin" in part._jdf.queryExecution().toString()


def test_snapshot_after_an_update(spark, state):
    log, graph, heads = state
    rows, fresh, moved = commits.commit(log, graph, heads, "main", spark.createDataFrame([(1, "update", '{"b":2}')], "feature_id long, operation string, properties string"), 9, 9)
    got = snapshot.snapshot(log.union(rows), graph.union(fresh), 9).collect()
    assert [(r.feature_id, r.properties, r.lng) for r in got] == [(1, '{"b":2}', 12.0)]
