"""Registered queries of writes that build on what is there: inherited content, repeated merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import columns as C
from .more_queries import _PLACED, _edit_graph, _edit_log
from .operators import commits, history, merging
from .plans.fixture import branches, changesets, table, versions
from .queries import _XY, query, with_fixture, xy


@query(with_fixture(f"""SELECT feature_id, CASE WHEN feature_id % 4 = 0 THEN 'new' ELSE json_extract_string(properties, '$.status') END AS status, CASE WHEN feature_id % 4 <> 0 THEN json_extract_string(properties, '$.cust') END AS cust, {_XY} FROM (
SELECT feature_id, properties, CASE WHEN feature_id % 4 <> 0 THEN 1.5::DOUBLE ELSE lng END AS lng, CASE WHEN feature_id % 4 <> 0 THEN 2.5::DOUBLE ELSE lat END AS lat FROM r WHERE operation <> 'delete' AND (feature_id % 4 = 0 OR feature_id % 9 = 0))""", (5, "r")))
def commit_contents(spark, sf):
    """Updates that give properties alone or coordinates alone: the rest is that of the branch's newest version."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).filter("k % 11 <> 0 and (k % 4 = 0 or k % 9 = 0)")
    props = F.when(F.col("k") % 4 == 0, F.lit('{"status":"new"}'))
    place = [F.when(F.col("k") % 4 != 0, F.lit(v)).alias(c) for c, v in (("lng", 1.5), ("lat", 2.5))]
    changes = o.select(F.col("k").alias("feature_id"), F.lit("update").alias("operation"), props.alias("properties"), *place)
    rows, _, _ = commits.commit(versions(spark, sf), changesets(spark), branches(spark), "fork", changes, 6, 6, expected_head=5)
    return rows.select("feature_id", C.prop("status").alias("status"), C.prop("cust").alias("cust"), *xy())


@query(f"SELECT k AS feature_id, 'again' AS seg, round(x, 6) AS lng, round(y, 6) AS lat, 4::BIGINT AS base FROM (SELECT c_custkey AS k, {_PLACED} FROM customer) WHERE k % 17 = 0 AND k % 2 <> 0 AND k % 5 <> 0 AND k % 11 <> 0")
def merged_again(spark, sf):
    """A branch that was merged once gets another commit and is merged again: from where the first merge took it."""
    log, graph = _edit_log(spark, sf), _edit_graph(spark)
    heads = spark.createDataFrame([("main", 2), ("clean", 4)], "name string, head long")
    rows, fresh, heads = merging.merge_commit(log, graph, heads, "main", "clean", 10, 10)
    log, graph = log.unionByName(rows), graph.unionByName(fresh)
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id")).filter("feature_id % 17 = 0 and feature_id % 2 <> 0 and feature_id % 5 <> 0 and feature_id % 11 <> 0")
    changes = own.select("feature_id", F.lit("update").alias("operation"), F.lit('{"seg":"again"}').alias("properties"))
    rows, fresh, heads = commits.commit(log, graph, heads, "clean", changes, 11, 11, expected_head=4)
    log, graph = log.unionByName(rows), graph.unionByName(fresh)
    base = history.merge_base(graph, 10, 11).select(F.col("id").alias("base"))
    rows, _, _ = merging.merge_commit(log, graph, heads, "main", "clean", 12, 12)
    return rows.select("feature_id", C.prop("seg").alias("seg"), *xy()).join(F.broadcast(base))
