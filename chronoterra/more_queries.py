"""Registered queries of writes, merges, requests, shapes, routes and verticals, with their SQL.

Shapes are boxes around customers, so that SQL can say in closed form what the general operators find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import fields, shapes
from .operators import commits, geometry, grids, linear, merging, network, pointcloud, records, requests, similarity, snapshot, trajectory, vector_tiles
from .plans.fixture import HEADS, branches, changesets, place, table, versions
from .queries import _CUST, _EDGES, _NEAR, _ROUTE, _SEG, _STATUS, _SUPP, _TILE, _XY, _edges, _fixes, _hav, _points, _routes, _snap, _vectors, query, with_fixture, xy

_PRIORITY = "json_extract_string(properties, '$.priority')"

# ---- reads and writes of the log ----------------------------------------------------------------


@query(with_fixture(f"SELECT feature_id, changeset_id, {_XY} FROM r WHERE operation <> 'delete' AND feature_id = 35", (4, "r")))
def feature_at(spark, sf):
    return snapshot.feature_at(versions(spark, sf), changesets(spark), 4, 35).select("feature_id", "changeset_id", *xy())


@query(with_fixture(f"""SELECT feature_id, {_XY} FROM r JOIN orders ON feature_id = o_orderkey WHERE operation <> 'delete' AND feature_id > 100 AND o_orderdate <= TIMESTAMP '1996-06-01 00:00:00'
AND (feature_id % 2 = 0 OR o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1996-06-01 00:00:00') ORDER BY feature_id LIMIT 200""", (5, "r")))
def valid_page(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("feature_id"), F.col("o_orderdate").cast("timestamp").alias("valid_from"))
    until = F.when(F.col("feature_id") % 2 == 1, F.col("valid_from") + F.expr("INTERVAL 365 DAY"))
    rows = _snap(spark, sf).join(o, "feature_id").withColumn("valid_to", until)
    return snapshot.page(rows, cursor=100, limit=200, valid=F.lit("1996-06-01 00:00:00").cast("timestamp")).select("feature_id", *xy())


@query(with_fixture(f"SELECT feature_id, to_json({{'status': {_STATUS}, 'cust': json_extract_string(properties, '$.cust')}})::VARCHAR AS properties FROM r WHERE operation <> 'delete'", (3, "r")))
def property_projection(spark, sf):
    return _snap(spark, sf, "main").select("feature_id", C.keep_properties(F.col("properties"), ["cust", "status"]).alias("properties"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    lives = F.col("k") % 11 != 0
    op = F.when((F.col("k") % 4 == 0) & lives, "update").when((F.col("k") % 9 == 0) & lives, "delete")
    one = lambda d, key: d.select(key.alias("feature_id"), "operation", F.to_json(F.struct(F.col("s").alias("status"))).alias("properties"), F.lit(1.5).alias("lng"), F.lit(2.5).alias("lat"))
    return one(o.withColumn("operation", op).filter("operation is not null"), F.col("k")).union(one(o.filter("k % 50 = 0").withColumn("operation", F.lit("insert")), F.col("k") + 10_000_000_000))


_CHANGED = """(SELECT o_orderkey AS feature_id, CASE WHEN o_orderkey % 4 = 0 THEN 'update' ELSE 'delete' END AS operation FROM orders WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 9 = 0)
UNION ALL SELECT o_orderkey + 10000000000, 'insert' FROM orders WHERE o_orderkey % 50 = 0)"""
_APPENDED = f"SELECT ((SELECT max(version_id) FROM fv) + row_number() OVER (ORDER BY feature_id))::BIGINT AS version_id, feature_id, 6::BIGINT AS changeset_id, operation FROM {_CHANGED}"


@query(with_fixture(_APPENDED))
def commit_rows(spark, sf):
    rows, _, _ = commits.commit(versions(spark, sf), changesets(spark), branches(spark), "fork", _changes(spark, sf), 6, 6, expected_head=5)
    return rows.select("version_id", "feature_id", "changeset_id", "operation")


@query(with_fixture(_APPENDED))
def batch_commit_rows(spark, sf):
    rows, _, _ = commits.push(versions(spark, sf), changesets(spark), branches(spark), "fork", 5, _changes(spark, sf), 6, 6)
    return rows.select("version_id", "feature_id", "changeset_id", "operation")


@query("SELECT * FROM (VALUES ('main', 3::BIGINT), ('fork', 6), ('copy', 6), ('blank', NULL)) t(name, head)")
def fork_and_commit_heads(spark, sf):
    _, _, moved = commits.commit(versions(spark, sf), changesets(spark), branches(spark), "fork", _changes(spark, sf), 6, 6, validate=False)
    return commits.fork(commits.fork(moved, "copy", "fork"), "blank").select("name", "head")


@query(with_fixture(f"""SELECT feature_id, operation FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY changeset_id DESC) AS n FROM fv WHERE changeset_id IN (4, 5)) WHERE n = 1"""))
def sync_pull(spark, sf):
    return commits.pull(versions(spark, sf), changesets(spark), HEADS["fork"], since=2).select("feature_id", "operation")


@query("SELECT * FROM (VALUES (5::BIGINT, 0), (2, 2), (1, 3), (3, -1)) t(peer, behind)")
def sync_status(spark, sf):
    cs = changesets(spark)
    return spark.createDataFrame([(p, commits.distance_behind(cs, HEADS["fork"], p)) for p in (5, 2, 1, 3)], "peer long, behind int")


@query("SELECT o_orderkey AS feature_id, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'update' END AS change FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 11 = 0")
def extracted_changes(spark, sf):
    return commits.extract_changes(versions(spark, sf), changesets(spark), HEADS["fork"], since=2).select("feature_id", "change")


@query("SELECT 5::BIGINT AS clock, (SELECT max(o_orderkey) FROM orders) AS top_id")
def max_clocks(spark, sf):
    clock = commits.event_clock(versions(spark, sf), changesets(spark), changesets(spark).limit(0))
    return _snap(spark, sf, "main").unionByName(versions(spark, sf)).agg(F.lit(clock).cast("long").alias("clock"), F.max("feature_id").alias("top_id"))


# ---- merges with every outcome --------------------------------------------------------------------


def _edit_graph(spark: SparkSession) -> DataFrame:
    """1 is the base; 2 (ours), 3 (theirs) and 4 (a side without conflicts) follow it."""
    rows = [(1, None, None, "main", 1), (2, 1, None, "main", 2), (3, 1, None, "work", 3), (4, 1, None, "clean", 4)]
    return spark.createDataFrame(rows, "id long, parent_id long, merge_parent_id long, branch string, created_at long")


def _edit_log(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), "c_mktsegment", "c_nationkey", F.col("c_custkey").alias("k"))
    k = F.col("k")
    lng, lat = place("k", "k")
    base = c.select("k", "feature_id", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), lng.alias("x"), lat.alias("y"))
    gone = lambda cond: F.when(cond, "delete").otherwise("update")

    def part(n: int, op, seg, level, x, y):
        props = F.to_json(F.struct(seg.alias("seg"), level.alias("level"), (F.col("nation") > 12).alias("far"), F.struct(F.col("nation").alias("nation")).alias("of")))
        return F.struct(F.lit(n).cast("long").alias("changeset_id"), op.alias("operation"), props.alias("properties"), x.alias("lng"), y.alias("lat"))

    seg, x, y, zero, one = F.col("seg"), F.col("x"), F.col("y"), F.lit(0), F.lit(1)
    parts = F.array(
        part(1, F.lit("insert"), seg, zero, x, y),
        part(2, gone(k % 11 == 0), F.when(k % 2 == 0, F.concat(seg, F.lit("A"))).otherwise(seg), zero, F.when(k % 5 == 0, x + 1).otherwise(x), y),
        part(3, gone(k % 13 == 0), F.when(k % 7 == 0, F.concat(seg, F.lit("B"))).otherwise(seg), F.when(k % 3 == 0, one).otherwise(zero), x, F.when(k % 10 == 0, y + 1).otherwise(y)),
        part(4, F.lit("update"), seg, one, x, y),
    )
    n = F.col("v.changeset_id")
    wanted = (n == 1) | ((n == 2) & ((k % 2 == 0) | (k % 5 == 0) | (k % 11 == 0))) | ((n == 3) & ((k % 3 == 0) | (k % 7 == 0) | (k % 10 == 0))) | ((n == 4) & (k % 3 == 0) & (k % 11 != 0))
    rows = base.select("feature_id", "k", F.explode(parts).alias("v")).filter(wanted)
    return rows.select((k * 10 + n).alias("version_id"), "feature_id", "v.*", n.alias("created_at"))


_KINDS = """e AS (SELECT c_custkey AS k, k % 2 = 0 OR k % 5 = 0 OR k % 11 = 0 AS o, k % 3 = 0 OR k % 7 = 0 OR k % 10 = 0 AS t, c_mktsegment AS seg FROM customer),
m AS (SELECT k AS feature_id, seg, CASE WHEN NOT t THEN 'ours' WHEN NOT o THEN 'theirs' WHEN k % 11 = 0 AND k % 13 = 0 THEN 'ours' WHEN k % 11 = 0 OR k % 13 = 0 THEN 'delete_modify'
  WHEN k % 10 = 0 AND k % 14 = 0 THEN 'full_conflict' WHEN k % 10 = 0 THEN 'geometry_conflict' WHEN k % 14 = 0 THEN 'property_conflict' ELSE 'merged' END AS choice FROM e WHERE o OR t)"""


@query(f"WITH {_KINDS} SELECT feature_id, choice FROM m")
def merge_outcomes(spark, sf):
    return merging.merge_choices(_edit_log(spark, sf), _edit_graph(spark), 2, 3).select("feature_id", "choice")


@query(f"WITH {_KINDS} SELECT feature_id, choice, CASE choice WHEN 'delete_modify' THEN 'review' WHEN 'full_conflict' THEN 'custom' ELSE 'auto_merge' END AS suggestion FROM m WHERE choice IN ('delete_modify', 'full_conflict', 'geometry_conflict', 'property_conflict')")
def merge_conflicts(spark, sf):
    return merging.conflicts(merging.merge_choices(_edit_log(spark, sf), _edit_graph(spark), 2, 3))


_KEPT = "json_extract_string(properties, '$.seg') AS seg, json_extract(properties, '$.level')::VARCHAR AS level, json_extract(properties, '$.far')::VARCHAR AS far, json_extract(properties, '$.of')::VARCHAR AS of_nation"


def _kept() -> list:
    """seg as text; the others as raw JSON, so that a number that became a string shows."""
    raw = C.json_entries(F.col("properties"))
    return [C.prop("seg").alias("seg"), raw["level"].alias("level"), raw["far"].alias("far"), raw["of"].alias("of_nation")]


_PLACED = "((k * 7919) % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS x, ((k * 104729) % 17000)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS y"


@query(f"""WITH e AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation, {_PLACED} FROM customer WHERE k % 3 = 0 AND k % 11 <> 0),
t AS (SELECT max(v) AS v FROM (SELECT c_custkey * 10 + CASE WHEN c_custkey % 3 = 0 AND c_custkey % 11 <> 0 THEN 4 WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 OR c_custkey % 10 = 0 THEN 3 WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 THEN 2 ELSE 1 END AS v FROM customer))
SELECT ((SELECT v FROM t) + row_number() OVER (ORDER BY k))::BIGINT AS version_id, k AS feature_id, CASE WHEN k % 2 = 0 THEN seg || 'A' ELSE seg END AS seg, '1' AS level, CASE WHEN nation > 12 THEN 'true' ELSE 'false' END AS far,
'{{"nation":' || nation || '}}' AS of_nation, round(CASE WHEN k % 5 = 0 THEN x + 1 ELSE x END, 6) AS lng, round(y, 6) AS lat FROM e""")
def merged_rows(spark, sf):
    rows = merging.merge(_edit_log(spark, sf), _edit_graph(spark), 2, 4, 5, 5)
    return rows.select("version_id", "feature_id", *_kept(), *xy())


@query(f"""WITH {_KINDS}, p AS (SELECT c_custkey AS k, c_nationkey AS nation, {_PLACED} FROM customer)
SELECT feature_id, CASE feature_id % 3 WHEN 0 THEN 'auto_merge' WHEN 1 THEN 'custom' ELSE 'theirs' END AS strategy, CASE WHEN feature_id % 3 = 2 AND k % 13 = 0 THEN 'delete' ELSE 'update' END AS operation,
CASE feature_id % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN seg || 'A' ELSE seg END WHEN 1 THEN 'own' ELSE CASE WHEN k % 7 = 0 THEN seg || 'B' ELSE seg END END AS seg,
round(CASE WHEN feature_id % 3 = 1 THEN 7.0 ELSE x END, 6) AS lng, round(CASE WHEN feature_id % 3 = 1 THEN 8.0 WHEN k % 10 = 0 THEN y + 1 ELSE y END, 6) AS lat
FROM m JOIN p ON k = feature_id WHERE choice IN ('delete_modify', 'full_conflict', 'geometry_conflict', 'property_conflict')""")
def settled_conflicts(spark, sf):
    log, graph = _edit_log(spark, sf), _edit_graph(spark)
    k = F.col("feature_id") % 3
    how = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id")).withColumn("strategy", F.when(k == 0, "auto_merge").when(k == 1, "custom").otherwise("theirs"))
    how = how.select("*", F.lit('{"seg":"own"}').alias("properties"), F.lit(7.0).alias("lng"), F.lit(8.0).alias("lat"))
    done = merging.resolve_conflicts(merging.merge_choices(log, graph, 2, 3), how, merging.diff(log, graph, 1, 2), merging.diff(log, graph, 1, 3))
    return done.select("feature_id", "strategy", "operation", C.prop("seg").alias("seg"), *xy())


@query(f"WITH {_KINDS} SELECT count(*) AS n, sum(feature_id)::BIGINT AS ids FROM m WHERE choice NOT IN ('ours', 'nothing')")
def resolved_merge(spark, sf):
    log, graph = _edit_log(spark, sf), _edit_graph(spark)
    how = log.select("feature_id", F.lit("theirs").alias("strategy")).distinct()
    return merging.resolve_and_merge(log, graph, 2, 3, how, 5, 5).agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


# ---- requests -------------------------------------------------------------------------------------


@query(with_fixture(f"SELECT feature_id, {_XY} FROM r WHERE operation <> 'delete' AND {_STATUS} = 'F' ORDER BY feature_id LIMIT 50 OFFSET 20", (3, "r")))
def cql2_request(spark, sf):
    request = {"filter-lang": "cql2-json", "filter": {"op": "=", "args": [{"property": "status"}, "F"]}, "limit": 50, "offset": 20}
    return requests.cql2_request(_snap(spark, sf, "main"), request).select("feature_id", *xy())


@query(with_fixture("SELECT feature_id, round(lat, 6) AS c1, round(lng, 6) AS c2 FROM r WHERE operation <> 'delete' AND lng BETWEEN -60 AND 40 AND lat BETWEEN -10 AND 45 ORDER BY feature_id LIMIT 100", (3, "r")))
def ogc_items(spark, sf):
    out = requests.items(_snap(spark, sf, "main"), window=(-10.0, -60.0, 45.0, 40.0), window_code="4326", code="4326", limit=100)
    return out.select("feature_id", F.round("c1", 6).alias("c1"), F.round("c2", 6).alias("c2"))


@query(with_fixture("SELECT feature_id, round(6378137.0::DOUBLE * radians(lng), 3) AS c1, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS c2 FROM r WHERE operation <> 'delete' AND feature_id = 10", (3, "r")))
def ogc_item(spark, sf):
    return requests.item(_snap(spark, sf, "main"), 10, code="3857").select("feature_id", F.round("c1", 3).alias("c1"), F.round("c2", 3).alias("c2"))


def _served(spark: SparkSession, sf: str) -> DataFrame:
    return _snap(spark, sf, "main").withColumn("oid", F.col("feature_id"))


@query(with_fixture(f"""SELECT oid, status, cust FROM (SELECT feature_id AS oid, {_STATUS} AS status, json_extract_string(properties, '$.cust')::BIGINT AS cust FROM r WHERE operation <> 'delete' AND lng BETWEEN -80 AND 100)
WHERE status IN ('F', 'O') AND cust BETWEEN 20 AND 90 ORDER BY status DESC, oid LIMIT 31 OFFSET 10""", (3, "r")))
def service_records(spark, sf):
    where = fields.among("status", "text", ["F", "O"]) & fields.between("cust", "integer", 20, 90)
    edge = 6378137.0 * 3.141592653589793 / 180
    rows = _served(spark, sf).withColumn("status", fields.typed("status", "text")).withColumn("cust", fields.typed("cust", "integer"))
    out = requests.records(rows, where, order=[("status", False)], envelope=(-80 * edge, -2e8, 100 * edge, 2e8), in_code=3857, offset=10, count=30)
    return out.select("oid", "status", "cust")


@query(with_fixture(f"SELECT count(*) AS n FROM r WHERE operation <> 'delete' AND {_PRIORITY} LIKE '_-%H%'", (3, "r")))
def service_count(spark, sf):
    return requests.records(_served(spark, sf), fields.matches("priority", "text", "_-%H%"), only="count")


@query(with_fixture(f"SELECT feature_id AS oid FROM r WHERE operation <> 'delete' AND json_extract_string(properties, '$.cust')::DOUBLE > 50.5 AND {_STATUS} <> 'P' AND json_extract_string(properties, '$.name') < 'o5'", (3, "r")))
def service_ids(spark, sf):
    where = fields.compare("cust", "double", ">", 50.5) & fields.compare("status", "text", "<>", "P") & fields.compare("name", "text", "<", "o5")
    return requests.records(_served(spark, sf), where, only="ids")


@query("SELECT event_id AS oid, CASE WHEN value = floor(value) THEN value::BIGINT END AS whole FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND strftime(ts, '%Y-%m-%dT%H:%M:%SZ') >= '2024-01-03T00:00:00Z'")
def typed_dates(spark, sf):
    from datetime import date

    e = table(spark, sf, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = e.select(F.col("event_id").alias("oid"), F.to_json(F.struct(stamp.alias("at"), F.format_string("%.6f", "value").alias("value"))).alias("properties"))
    return rows.filter(fields.compare("at", "text", ">=", date(2024, 1, 3))).select("oid", fields.typed("value", "integer").alias("whole"))


# ---- shapes ---------------------------------------------------------------------------------------

_BOX = f"b AS (SELECT feature_id, lng AS x0, lat AS y0, lng + 1 + feature_id % 4 AS x1, lat + 1 + feature_id % 3 AS y1 FROM {_CUST})"
_INSIDE = "x0 <= 60 AND x1 >= -60 AND y0 <= 30 AND y1 >= -30"
_AREA = "(x1 - x0) * (y1 - y0)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf, "customer", "c")
    k, x, y = F.col("feature_id"), F.col("lng"), F.col("lat")
    w, h = x + 1 + k % 4, y + 1 + k % 3
    ring = F.array(*[shapes.point(a, b) for a, b in ((x, y), (w, y), (w, h), (x, h), (x, y))])
    return p.select("feature_id", "seg", ring.alias("ring"))


_WINDOW = [(-60, -30), (60, -30), (60, 30), (-60, 30), (-60, -30)]


def _area(ring="ring"):
    return F.round(F.abs(shapes.twice_area(F.col(ring))) / 2, 6).alias("area")


_CUT = "(least(x1, 60) - greatest(x0, -60)) * (least(y1, 30) - greatest(y0, -30))"


@query(f"WITH {_BOX} SELECT feature_id, round({_CUT}, 6) AS area FROM b WHERE {_INSIDE}")
def clip_shapes(spark, sf):
    return geometry.clip(_boxes(spark, sf), shapes.line(*_WINDOW)).select("feature_id", _area())


@query(f"WITH {_BOX} SELECT feature_id, seg, round(greatest(x0, -60), 6) AS xmin, round(least(y1, 30), 6) AS ymax FROM b JOIN (SELECT c_custkey AS feature_id, c_mktsegment AS seg FROM customer) USING (feature_id) WHERE {_INSIDE}")
def intersect_shapes(spark, sf):
    out = geometry.intersect(_boxes(spark, sf), shapes.line(*_WINDOW))
    box = shapes.bounds(F.col("ring"))
    return out.select("feature_id", "seg", F.round(box["xmin"], 6).alias("xmin"), F.round(box["ymax"], 6).alias("ymax"))


@query(f"WITH {_BOX} SELECT feature_id, round({_AREA} - {_CUT}, 6) AS area FROM b WHERE {_INSIDE} AND {_AREA} - {_CUT} > 1e-9")
def difference_shapes(spark, sf):
    out = geometry.difference(_boxes(spark, sf), shapes.line(*_WINDOW)).select("feature_id", F.explode("rings").alias("ring"))
    return out.groupBy("feature_id").agg(F.round(F.sum(F.abs(shapes.twice_area(F.col("ring")))) / 2, 6).alias("area"))


@query(f"WITH {_BOX} SELECT feature_id, part, round(CASE part WHEN 0 THEN (0.5 - x0) * (y1 - y0) ELSE (x1 - 0.5) * (y1 - y0) END, 6) AS area FROM b, (VALUES (0), (1)) t(part) WHERE x0 < 0.5 AND x1 > 0.5")
def split_shapes(spark, sf):
    return geometry.split_by_line(_boxes(spark, sf), (0.5, -90.0), (0.5, 90.0)).select("feature_id", "part", _area())


@query(f"WITH {_BOX} SELECT feature_id, (2 * ceil((x1 - x0) / 0.4) + 2 * ceil((y1 - y0) / 0.4) + 1)::INT AS n, round({_AREA}, 6) AS area FROM b")
def densify_shapes(spark, sf):
    dense = _boxes(spark, sf).select("feature_id", shapes.densify(F.col("ring"), 0.4).alias("ring"))
    return dense.select("feature_id", F.size("ring").alias("n"), _area())


_SPHERE = "6371000.0::DOUBLE * 6371000.0::DOUBLE * radians(x1 - x0) * abs(sin(radians(y1)) - sin(radians(y0)))"


@query(f"""WITH {_BOX}, s AS (SELECT *, {_SPHERE} AS area, {_hav('x0', 'y0', 'x1', 'y0')} + {_hav('x1', 'y0', 'x1', 'y1')} + {_hav('x1', 'y1', 'x0', 'y1')} + {_hav('x0', 'y1', 'x0', 'y0')} AS length FROM b)
SELECT count(*) AS n, round(sum(area) / 1e9, 3) AS area, round(sum(length) / 1e3, 3) AS length, round(min(x0), 6) AS xmin, round(min(y0), 6) AS ymin, round(max(x1), 6) AS xmax, round(max(y1), 6) AS ymax, round(avg((x0 + x1) / 2), 4) AS cx, round(avg((y0 + y1) / 2), 4) AS cy FROM s""")
def spatial_stats(spark, sf):
    s = geometry.shape_stats(_boxes(spark, sf).withColumn("path", F.col("ring")))
    return s.select("n", F.round(F.col("area") / 1e9, 3).alias("area"), F.round(F.col("length") / 1e3, 3).alias("length"), *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], *[F.round(c, 4).alias(c) for c in ("cx", "cy")])


@query(with_fixture("SELECT count(*) AS total, count(*) FILTER (WHERE lng IS NULL) AS null_geometry, count(*) FILTER (WHERE lng > 180) AS invalid_geometry FROM fv"))
def quality_counts(spark, sf):
    return geometry.quality(versions(spark, sf))


@query(f"WITH {_BOX} SELECT feature_id, round({_AREA}, 6) AS area, 5 AS n FROM b WHERE feature_id % 3 <> 0")
def repaired_shapes(spark, sf):
    k, r = F.col("feature_id"), F.col("ring")
    broken = F.when(k % 3 == 1, F.slice(r, 1, 4)).when(k % 3 == 2, F.flatten(F.transform(r, lambda p: F.array(p, p)))).otherwise(r)
    return geometry.repaired(_boxes(spark, sf).select("feature_id", broken.alias("ring"))).select("feature_id", _area(), F.size("ring").alias("n"))


@query(f"WITH {_BOX} SELECT feature_id, 2 AS outers, 1 AS holes, round({_AREA} * 0.25, 6) AS hole FROM b")
def assembled_rings(spark, sf):
    r = F.col("ring")
    moved = lambda size, far: F.transform(r, lambda p: shapes.point(r[0]["x"] + far + (p["x"] - r[0]["x"]) * size, r[0]["y"] + (p["y"] - r[0]["y"]) * size))
    hole = F.transform(moved(0.5, 0.0), lambda p: shapes.point(p["x"] + 0.1, p["y"] + 0.1))
    rings = F.array(shapes.wound(moved(1.0, 500.0), True), shapes.wound(r, True), shapes.wound(hole, False))
    made = _boxes(spark, sf).select("feature_id", shapes.assemble(rings).alias("p"))
    return made.select("feature_id", F.size("p").alias("outers"), F.size(F.col("p")[1]["holes"]).alias("holes"), F.round(F.abs(shapes.twice_area(F.col("p")[1]["holes"][0])) / 2, 6).alias("hole"))


@query(f"WITH {_BOX} SELECT a.feature_id AS a, b.feature_id AS b FROM b a JOIN b b ON a.feature_id <> b.feature_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def spatial_join(spark, sf):
    b = _boxes(spark, sf)
    return geometry.spatial_join(b, b, "intersects", 4.0)


@query(f"WITH {_BOX} SELECT a.feature_id AS a, b.feature_id AS b, seg FROM b a JOIN b b ON a.feature_id <> b.feature_id AND a.x0 > b.x0 AND a.x1 < b.x1 AND a.y0 > b.y0 AND a.y1 < b.y1 JOIN (SELECT c_custkey, c_mktsegment AS seg FROM customer) ON c_custkey = b.feature_id")
def within_join(spark, sf):
    b = _boxes(spark, sf)
    return geometry.spatial_join(b, b, "within", 4.0, keep=("seg",))


@query(f"WITH {_BOX} SELECT a.feature_id AS a, b.feature_id AS b FROM b a JOIN b b ON a.feature_id < b.feature_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def overlapping_pairs(spark, sf):
    return geometry.overlapping_pairs(_boxes(spark, sf), 4.0)


@query(f"WITH {_BOX} SELECT feature_id, round(x0, 6) AS xmin, round(y0, 6) AS ymin, round(x1, 6) AS xmax, round(y1, 6) AS ymax, 93 AS size FROM b")
def wkb_round_trip(spark, sf):
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))
    back = geometry.from_wkb(geometry.to_wkb(_boxes(spark, sf).select("feature_id", text.alias("geojson"))).select("feature_id", "wkb"))
    return back.select("feature_id", "wkb", geometry.geojson_bounds(F.col("geojson")).alias("b")).select("feature_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.octet_length("wkb").alias("size"))


@query("SELECT s_suppkey AS feature_id, (2 * (s_suppkey % 5) + 6)::INT AS before, 3 AS after FROM supplier")
def simplify_paths(spark, sf):
    n = (F.col("s_suppkey") % 5 + 2).cast("int")
    across = F.transform(F.sequence(F.lit(0), n), lambda i: shapes.point(i.cast("double"), F.lit(0.0)))
    up = F.transform(F.sequence(F.lit(1), n + 1), lambda i: shapes.point(n.cast("double"), i.cast("double")))
    paths = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("feature_id"), F.concat(across, up).alias("path"))
    return geometry.simplify(paths, 0.01).select("feature_id", "before", "after")


@query(f"WITH p AS {_SUPP} SELECT feature_id, round(16 * pow(5000 / 111320.0::DOUBLE, 2) * sin(pi() / 16), 9) AS area FROM p")
def buffer_shapes(spark, sf):
    return geometry.buffers(_points(spark, sf, "supplier", "s"), 5000.0).filter("area > 0").select("feature_id", F.round(F.abs(shapes.twice_area(F.col("ring"))) / 2, 9).alias("area"))


@query(f"WITH b AS (SELECT feature_id, floor(lng)::INT AS x0, floor(lat)::INT AS y0 FROM {_CUST}), c AS (SELECT c_mktsegment AS key, x, y, feature_id FROM b JOIN customer ON c_custkey = feature_id, LATERAL (SELECT unnest(range(x0, (x0 + 1 + feature_id % 4)::INT)) AS x), LATERAL (SELECT unnest(range(y0, (y0 + 1 + feature_id % 3)::INT)) AS y)) SELECT key, count(DISTINCT feature_id) AS n, count(DISTINCT (x, y))::DOUBLE AS planar FROM c GROUP BY 1")
def union_shapes(spark, sf):
    p = _points(spark, sf, "customer", "c")
    k, x, y = F.col("feature_id"), F.floor("lng").cast("double"), F.floor("lat").cast("double")
    w, h = x + 1 + k % 4, y + 1 + k % 3
    ring = F.array(*[shapes.point(a, b) for a, b in ((x, y), (w, y), (w, h), (x, h), (x, y))])
    out = geometry.union_area(p.select("feature_id", "seg", ring.alias("ring")), 4.0, by="seg")
    return out.select("key", "n", F.round("planar", 6).alias("planar"))


@query(None)
def convex_hull(spark, sf):
    return geometry.convex_hull(_points(spark, sf, "customer", "c"))


@query(f"WITH p AS {_CUST}, {_TILE} SELECT tx, ty, count(*) AS n, true AS filled FROM u GROUP BY 1, 2")
def encoded_tiles(spark, sf):
    return vector_tiles.encoded_tiles(_points(spark, sf, "customer", "c"), 6).select("tx", "ty", "n", (F.octet_length("mvt") > 10).alias("filled"))


@query(with_fixture(f", p AS (SELECT * FROM m WHERE operation <> 'delete' UNION ALL SELECT * FROM k WHERE operation <> 'delete'), {_TILE} SELECT tx, ty, count(*) AS n FROM u GROUP BY 1, 2", (3, "m"), (5, "k")).replace("\n,", ","))
def dataset_tiles(spark, sf):
    return vector_tiles.dataset_tiles(versions(spark, sf), changesets(spark), branches(spark), 6)


# ---- grids and rasters ----------------------------------------------------------------------------


@query(f"WITH c AS {_CUST}, t AS (SELECT DISTINCT 6 AS zoom, (least(greatest(floor((lat + 90) / 180 * 64), 0), 63) * 64 + least(greatest(floor((lng + 180) / 360 * 64), 0), 63))::BIGINT AS cell FROM c) SELECT count(*) AS tiles, min(zoom) AS min_zoom, max(zoom) AS max_zoom FROM t")
def band_stats(spark, sf):
    cells = grids.indexed(_points(spark, sf, "customer", "c"), 6).select(F.lit(6).alias("zoom"), "cell").distinct()
    return grids.band_stats(cells)


@query("SELECT * FROM (VALUES (1, 0::BIGINT), (2, 2), (2, 3), (2, 6), (3, 63)) t(zoom, cell)")
def compact_cells(spark, sf):
    cells = [r * 8 + c for r in range(4) for c in range(4)] + [r * 8 + c for r in (0, 1) for c in (4, 5, 6, 7)] + [r * 8 + c for r in (2, 3) for c in (4, 5)] + [63]
    return grids.compact(spark.createDataFrame([(c,) for c in cells], "cell long"), 3)


@query(f"WITH p AS {_SUPP} SELECT DISTINCT cell, (cell % 32) * 11.25 - 180 AS xmin, (cell // 32) * 5.625 - 90 AS ymin FROM (SELECT (least(greatest(floor((lat + 90) / 180 * 32), 0), 31) * 32 + least(greatest(floor((lng + 180) / 360 * 32), 0), 31))::BIGINT AS cell FROM p)")
def cell_boundaries(spark, sf):
    cells = grids.indexed(_points(spark, sf, "supplier", "s"), 5).select("cell").distinct()
    return grids.cell_boundary(cells, 5).select("cell", "xmin", "ymin")


# ---- routes and trajectories ----------------------------------------------------------------------

_SPANS = "e AS (SELECT s_suppkey % 50 AS route, s_suppkey AS event, s_suppkey * 50001.5::DOUBLE AS lo, s_suppkey * 150001.5::DOUBLE AS hi FROM supplier)"


def _spans(spark: SparkSession, sf: str, name: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select((s % 50).alias("route"), s.alias(name), (s * F.lit(50001.5)).alias("start"), (s * F.lit(150001.5)).alias("end"))


def _at(goal: str, c: str) -> str:
    return f"(SELECT {c} + ({goal} - measure) / (m2 - measure) * ({c}2 - {c}) FROM g WHERE g.route = e.route AND measure <= {goal} AND m2 > {goal})"


_LEAD = "g AS (SELECT *, lead(measure) OVER w AS m2, lead(lng) OVER w AS lng2, lead(lat) OVER w AS lat2 FROM m WINDOW w AS (PARTITION BY route ORDER BY seq))"


@query(_ROUTE + f", {_SPANS}, {_LEAD}, f AS (SELECT route, event, {_at('lo', 'lng')} AS x1, {_at('lo', 'lat')} AS y1, {_at('hi', 'lng')} AS x2, {_at('hi', 'lat')} AS y2 FROM e) SELECT route, event, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM f WHERE x1 IS NOT NULL AND x2 IS NOT NULL")
def linear_events(spark, sf):
    return linear.linear_events(_routes(spark, sf), _spans(spark, sf, "event")).select("route", "event", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(_ROUTE + f", {_SPANS}, t AS (SELECT route, max(measure) AS total FROM m GROUP BY 1), c AS (SELECT route, event AS span, least(lo, total) AS lo, least(hi, total) AS hi FROM e JOIN t USING (route)) SELECT route, span, (2 + (SELECT count(*) FROM m WHERE m.route = c.route AND measure > lo AND measure < hi))::INT AS n FROM c")
def route_sublines(spark, sf):
    return linear.sublines(_routes(spark, sf), _spans(spark, sf, "span")).select("route", "span", F.size("path").alias("n"))


@query(_ROUTE + f""", {_LEAD}, pp AS (SELECT feature_id % 50 AS route, feature_id AS point, lng AS px, lat AS py FROM {_SUPP}), q AS (SELECT route, point, px, py, lng, lat, measure, m2, lng2, lat2, pow(lng2 - lng, 2) + pow(lat2 - lat, 2) AS size FROM pp JOIN g USING (route) WHERE m2 IS NOT NULL),
r AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(1, ((px - lng) * (lng2 - lng) + (py - lat) * (lat2 - lat)) / size)) ELSE 0 END AS t FROM q),
b AS (SELECT route, point, min({{'off': pow(lng + t * (lng2 - lng) - px, 2) + pow(lat + t * (lat2 - lat) - py, 2), 'at': measure + t * (m2 - measure)}}) AS b FROM r GROUP BY 1, 2)
SELECT route, point, round(b['at'], 2) AS measure FROM b""")
def located_points(spark, sf):
    p = _points(spark, sf, "supplier", "s").select((F.col("feature_id") % 50).alias("route"), F.col("feature_id").alias("point"), "lng", "lat")
    return linear.locate_points(_routes(spark, sf), p).select("route", "point", F.round("measure", 2).alias("measure"))


@query("SELECT user_id AS traj, count(*) AS n, epoch_us(min(ts))::DOUBLE / 1e6 AS start, epoch_us(max(ts))::DOUBLE / 1e6 AS \"end\" FROM events GROUP BY 1")
def trajectory_periods(spark, sf):
    return trajectory.periods(_fixes(spark, sf))


@query("SELECT user_id AS traj, count(*)::INT AS before FROM events GROUP BY 1")
def trajectory_simplified(spark, sf):
    return trajectory.simplify(_fixes(spark, sf), 1.0).filter("after <= before and after >= least(before, 2)").select("traj", "before")


@query(_SEG + f""", a AS (SELECT * FROM g WHERE traj = (SELECT min(traj) FROM f) AND sec > 0), b AS (SELECT * FROM g WHERE traj = (SELECT max(traj) FROM f) AND sec > 0),
m AS (SELECT greatest(a.ts, b.ts) AS lo, least(a.ts2, b.ts2) AS hi, a.ts AS ats, a.sec AS asec, a.lng AS ax, a.lat AS ay, a.lng2 - a.lng AS adx, a.lat2 - a.lat AS ady, b.ts AS bts, b.sec AS bsec, b.lng AS bx, b.lat AS b_y, b.lng2 - b.lng AS bdx, b.lat2 - b.lat AS bdy FROM a JOIN b ON a.ts < b.ts2 AND b.ts < a.ts2),
d AS (SELECT *, ax + (lo - ats) / asec * adx - bx - (lo - bts) / bsec * bdx AS x0, ay + (lo - ats) / asec * ady - b_y - (lo - bts) / bsec * bdy AS y0, ax + (hi - ats) / asec * adx - bx - (hi - bts) / bsec * bdx AS x1, ay + (hi - ats) / asec * ady - b_y - (hi - bts) / bsec * bdy AS y1 FROM m),
w AS (SELECT *, lo + CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) > 0 THEN greatest(0, least(1, -(x0 * (x1 - x0) + y0 * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) ELSE 0 END * (hi - lo) AS t FROM d),
p AS (SELECT t, ax + (t - ats) / asec * adx AS px, ay + (t - ats) / asec * ady AS py, bx + (t - bts) / bsec * bdx AS qx, b_y + (t - bts) / bsec * bdy AS qy FROM w)
SELECT round(min({_hav('px', 'py', 'qx', 'qy')}) / 1e3, 3) AS km FROM p HAVING count(*) > 0""")
def nearest_approach(spark, sf):
    f = _fixes(spark, sf)
    lo, hi = f.agg(F.min("traj"), F.max("traj")).first()
    return trajectory.nearest_approach(f, lo, hi).select(F.round(F.col("metres") / 1e3, 3).alias("km"))


# ---- networks and vectors -------------------------------------------------------------------------

_EVERY = _EDGES.replace(_NEAR, "")


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_EVERY}, b AS (SELECT from_id, to_id FROM e UNION SELECT to_id, from_id FROM e),
w(id, root) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT b.to_id, w.root FROM w JOIN b ON b.from_id = w.id), c AS (SELECT id, min(root) AS component FROM w GROUP BY 1)
SELECT count(*) AS junctions, (SELECT count(*) FROM e) AS edges, count(DISTINCT component) AS components, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT from_id FROM b)) AS isolated FROM c""")
def connectivity_report(spark, sf):
    return network.connectivity(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")), _edges(spark, sf, True))


@query(None)
def network_tour(spark, sf):
    found = network.tour(_edges(spark, sf, True), [0, 5, 9, 14, 20])
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(found)], "place int, stop long, cost double")


@query("""WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a, b, round(max(s), 6) AS score FROM (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, list_cosine_similarity(x.v, y.v) AS s
FROM v x JOIN v y ON x.id <> y.id) WHERE s > 0.3 GROUP BY 1, 2""")
def vector_duplicates(spark, sf):
    return similarity.similar_pairs(_vectors(spark, sf), 0.3).select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS a FROM v, range(1, 65) t(i) GROUP BY i)),
d AS (SELECT id, round(1 - list_cosine_similarity(v, c), 9) AS d FROM v, m), b AS (SELECT id, ntile(5) OVER (ORDER BY d, id) AS bucket, (row_number() OVER (ORDER BY d, id) - 1) // 100 AS block FROM d)
SELECT bucket::INT AS bucket, block::BIGINT AS block, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM b GROUP BY 1, 2""")
def bucket_members(spark, sf):
    out = similarity.bucket_members(_vectors(spark, sf), 64, 5, block=100)
    return out.select("bucket", "block", F.array_join("ids", ",").alias("ids"))


@query(f"WITH p AS {_SUPP} SELECT feature_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM p WHERE lng BETWEEN -100 AND 100 AND lat BETWEEN -40 AND 60")
def native_window(spark, sf):
    x, y = C.mercator(F.col("lng"), F.col("lat"))
    stored = _points(spark, sf, "supplier", "s").select("feature_id", x.alias("x"), y.alias("y"))
    return requests.native_window(stored, (-100.0, -40.0, 100.0, 60.0), 3857).select("feature_id", *xy())


# ---- verticals ------------------------------------------------------------------------------------


def _attributes(spark: SparkSession, sf: str, *columns) -> DataFrame:
    """Customers as features with the given attributes and their points."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), F.to_json(F.struct(*columns)).alias("properties"))
    return c.join(_points(spark, sf, "customer", "c"), "feature_id")


@query("SELECT c_custkey AS feature_id, c_name AS name, c_mktsegment AS sensor_type, c_acctbal AS value FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 120) WHERE c_mktsegment = 'BUILDING'")
def sensors(spark, sf):
    rows = _attributes(spark, sf, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sensor_type"), F.col("c_acctbal").alias("value"))
    return records.listing(rows, {"name": "text", "sensor_type": "text", "value": "number"}, limit=120, equal={"sensor_type": "BUILDING"})


@query("SELECT c_custkey AS feature_id, c_acctbal AS value, 'C' AS unit FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1000) WHERE c_nationkey = 7")
def sensor_readings(spark, sf):
    rows = _attributes(spark, sf, F.col("c_nationkey").cast("string").alias("sensor_id"), F.col("c_acctbal").alias("value"), F.lit("C").alias("unit"))
    return records.listing(rows, {"value": "number", "unit": "text"}, limit=5000, most=1000, equal={"sensor_id": "7"})


@query("SELECT c_custkey AS feature_id, c_name AS milestone_name, c_acctbal AS completion_pct FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 200) WHERE c_custkey % 3 = 0")
def milestones(spark, sf):
    rows = _attributes(spark, sf, F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("milestone_name"), F.col("c_acctbal").alias("completion_pct"))
    return records.listing(rows, {"milestone_name": "text", "completion_pct": "number"}, limit=900, most=200, having="milestone_name")


@query("SELECT c_custkey AS feature_id, c_name AS name, c_mktsegment AS crop, c_acctbal AS area_ha, NULL::VARCHAR AS soil_type FROM customer ORDER BY c_custkey LIMIT 100")
def farm_fields(spark, sf):
    rows = _attributes(spark, sf, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("crop"), F.col("c_acctbal").alias("area_ha"))
    return records.listing(rows, {"name": "text", "crop": "text", "area_ha": "number", "soil_type": "text"})


@query("SELECT c_custkey AS feature_id, c_mktsegment AS incident_type, 'active' AS status FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 500) WHERE c_custkey % 2 = 0 AND c_mktsegment = 'MACHINERY'")
def incidents(spark, sf):
    rows = _attributes(spark, sf, F.col("c_mktsegment").alias("incident_type"), F.when(F.col("c_custkey") % 2 == 0, "active").otherwise("closed").alias("status"))
    return records.listing(rows, {"incident_type": "text", "status": "text"}, limit=500, equal={"status": "active", "incident_type": "MACHINERY"})


@query("SELECT 3::BIGINT AS count_a, 8::BIGINT AS count_b, round(b.c_acctbal - a.c_acctbal, 4) AS mean_diff, round(abs(least(b.c_acctbal - a.c_acctbal, 0)), 4) AS max_cut, round(greatest(b.c_acctbal - a.c_acctbal, 0), 4) AS max_fill, round((b.c_acctbal - a.c_acctbal) * 8, 4) AS volume FROM customer a, customer b WHERE a.c_custkey = 3 AND b.c_custkey = 8")
def survey_compare(spark, sf):
    out = records.survey_compare(_attributes(spark, sf, F.col("c_custkey").alias("point_count"), F.col("c_acctbal").alias("mean_elevation")), 3, 8)
    return out.select("count_a", "count_b", *[F.round(c, 4).alias(c) for c in ("mean_diff", "max_cut", "max_fill", "volume")])


@query(f"""WITH p AS {_SUPP} SELECT feature_id AS tower, round(43 - (69.55 + 26.16 * log10(900 + feature_id) - 13.82 * log10(30.0) + (44.9 - 6.55 * log10(30.0)) * log10(4.0)), 6) AS edge_dbm, round(16 * pi(), 6) AS area_km2,
round(lng + 4000 / 111320.0::DOUBLE, 8) AS east FROM p""")
def tower_coverage(spark, sf):
    t = _points(spark, sf, "supplier", "s").select(F.col("feature_id").alias("tower"), "lng", "lat", F.lit(30.0).alias("height_m"), (F.col("feature_id") + 900.0).alias("mhz"), F.lit(43.0).alias("dbm"), F.lit(4000.0).alias("radius_m"))
    out = records.coverage(t)
    return out.select("tower", F.round("edge_dbm", 6).alias("edge_dbm"), F.round("area_km2", 6).alias("area_km2"), F.round(F.col("ring")[0]["x"], 8).alias("east"))


@query(f"WITH p AS {_SUPP} SELECT feature_id AS id, round({_hav('10.0::DOUBLE', '20.0::DOUBLE', 'lng', 'lat')}, 3) AS metres, round({_hav('10.0::DOUBLE', '20.0::DOUBLE', 'lng', 'lat')} / (5000.0 / 60), 3) AS minutes FROM p")
def evacuation(spark, sf):
    p = _points(spark, sf, "supplier", "s").select(F.col("feature_id").alias("id"), "lng", "lat")
    return records.assembly_points(p, 10.0, 20.0).select("id", F.round("metres", 3).alias("metres"), F.round("minutes", 3).alias("minutes"))


@query("SELECT c_custkey AS feature_id FROM customer WHERE lower(c_name) LIKE '%00012%' OR lower(c_mktsegment) LIKE '%00012%' ORDER BY 1 LIMIT 500")
def parcel_search(spark, sf):
    rows = _attributes(spark, sf, F.col("c_name").alias("owner"), F.col("c_mktsegment").alias("address"))
    return records.parcel_search(rows, "00012", limit=900).select("feature_id")


_SALES = f"""WITH p AS {_CUST}, q AS (SELECT p.*, c_acctbal AS price, feature_id % 90 AS sqft FROM p JOIN customer ON c_custkey = feature_id WHERE pow(lng - 10, 2) + pow(lat - 5, 2) <= pow(4000000 / 111320.0::DOUBLE, 2) ORDER BY feature_id LIMIT 200),
s AS (SELECT feature_id, price, {_hav('10.0::DOUBLE', '5.0::DOUBLE', 'lng', 'lat')} AS metres FROM q WHERE (feature_id % 7 = 0 OR sqft BETWEEN 20 AND 70) AND (feature_id % 4 = 0 OR feature_id % 400 <= 300) ORDER BY metres, feature_id LIMIT 40) """


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    day = F.date_format(F.date_sub(F.lit("2024-06-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd")
    rows = _attributes(spark, sf, F.col("c_acctbal").alias("price"), F.when(k % 7 != 0, k % 90).alias("sqft"), F.when(k % 4 == 0, "unknown").otherwise(day).alias("sale_date"), k)
    own = F.to_json(F.struct(C.prop("price").cast("double").alias("price"), C.prop("sqft").cast("double").alias("sqft"), C.prop("sale_date").alias("sale_date"), "lng", "lat"))
    return records.comparable_sales(rows.withColumn("properties", own), 10.0, 5.0, 4_000_000.0, F.lit("2024-06-01").cast("date"), sqft=(20, 70), max_age_days=300, limit=40)


@query(_SALES + "SELECT feature_id, round(metres, 3) AS metres, price FROM s")
def comparable_sales(spark, sf):
    return _sales(spark, sf).select("feature_id", F.round("metres", 3).alias("metres"), "price")


@query(_SALES + "SELECT count(*) AS n, round(avg(price), 4) AS mean, (list(price ORDER BY price))[(count(*) // 2 + 1)::BIGINT] AS median, min(price) AS low, max(price) AS high FROM s")
def sales_summary(spark, sf):
    return records.sales_summary(_sales(spark, sf)).withColumn("mean", F.round("mean", 4))


@query("""SELECT o_custkey AS feature_id, 'forward' AS direction, o_orderstatus AS class, coalesce(CASE o_orderstatus WHEN 'F' THEN 'placed' END, '') AS label, o_orderkey + 1000000000 AS related FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey + 1000000000, 'backward', o_orderstatus, 'by', o_custkey FROM orders WHERE o_orderstatus <> 'P'""")
def related_records(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("class"), F.col("o_custkey").alias("origin"), (F.col("o_orderkey") + 1_000_000_000).alias("destination"))
    classes = spark.createDataFrame([("F", "placed", "by"), ("O", None, "by")], "class string, forward string, backward string")
    everyone = o.select(F.col("origin").alias("feature_id")).union(o.select("destination")).distinct()
    return records.related(everyone, o, classes)


@query("SELECT n_nationkey AS dataset FROM nation WHERE n_regionkey = 1 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def datasets_of_user(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("dataset"), (F.col("n_regionkey") == 1).alias("public"))
    grants = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("user"))
    return records.visible(n, grants, "BUILDING").select("dataset")


@query("""WITH d AS (SELECT n_nationkey AS dataset, n_name AS name FROM nation WHERE n_name ILIKE '%1%' AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY 2, 1 LIMIT 50),
t AS (SELECT c_nationkey AS dataset, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS tags FROM customer GROUP BY 1) SELECT dataset, name, coalesce(tags, '') AS tags FROM d LEFT JOIN t USING (dataset)""")
def catalog_search(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"))
    tags = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("tag"))
    return records.catalog_search(n, tags, "1", tag="BUILDING").select("dataset", "name", F.array_join("tags", ",").alias("tags"))


@query("SELECT c_mktsegment AS tag, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1")
def tag_counts(spark, sf):
    return records.tag_counts(table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("tag")))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    box = shapes.bounds(F.col("ring"))
    return _boxes(spark, sf).select(F.col("feature_id").alias("item"), F.col("seg").alias("collection"), *[box[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {_BOX} SELECT feature_id AS item, c_mktsegment AS collection FROM b JOIN customer ON c_custkey = feature_id WHERE {_INSIDE} AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY 2, 1 LIMIT 25")
def stac_search(spark, sf):
    return records.stac_search(_catalog(spark, sf), [-60.0, -30.0, 60.0, 30.0], ["BUILDING", "MACHINERY"], limit=25).select("item", "collection")


# ---- point clouds ---------------------------------------------------------------------------------


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).withColumn("n_points", F.col("item") % 100).withColumnRenamed("item", "patch")


@query(f"WITH {_BOX} SELECT count(*) AS patches, sum(feature_id % 100)::BIGINT AS points FROM b WHERE {_INSIDE}")
def point_cloud_window(spark, sf):
    return pointcloud.stats(pointcloud.overlapping(_patches(spark, sf), -60.0, -30.0, 60.0, 30.0)).select("patches", "points")


@query(f"WITH {_BOX} SELECT count(*) AS patches, sum(feature_id % 100)::BIGINT AS points, round(min(x0), 6) AS xmin, round(max(y1), 6) AS ymax FROM b")
def point_cloud_stats(spark, sf):
    return pointcloud.stats(_patches(spark, sf)).select("patches", "points", F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"))


@query(f"WITH p AS {_CUST}, s AS (SELECT i, -100.0 + 200.0::DOUBLE * i / 20 AS x, -50.0 + 100.0::DOUBLE * i / 20 AS y FROM range(21) t(i)) SELECT i, round(avg(feature_id), 6) AS z FROM s LEFT JOIN p ON sqrt(pow(x - lng, 2) + pow(y - lat, 2)) <= 3 GROUP BY 1")
def elevation_profile(spark, sf):
    p = _points(spark, sf, "customer", "c").select(F.col("lng").alias("x"), F.col("lat").alias("y"), F.col("feature_id").cast("double").alias("z"))
    return pointcloud.profile(p, (-100.0, -50.0), (100.0, 50.0), n=20, reach=3.0).select("i", F.round("z", 6).alias("z"))


from . import log_queries  # noqa: E402, F401  registers its own, from what is defined above
