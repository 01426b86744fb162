"""Registered queries of the versioned-geodata operators over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.cql2 import to_column
from .operators import governance, grids, history, linear, merging, network, similarity, snapshot, spatial, statistics, trajectory
from .plans.fixture import HEADS, ORACLE, branches, changesets, oracle_latest, place, table, versions
from .streaming import change_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers the function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def with_fixture(sql: str, *latest: tuple[int, str]) -> str:
    return "WITH RECURSIVE " + ",\n".join([ORACLE.strip(), *(oracle_latest(h, n) for h, n in latest)]) + "\n" + sql


def _snap(spark: SparkSession, sf: str, branch: str = "fork") -> DataFrame:
    return snapshot.snapshot(versions(spark, sf), changesets(spark), HEADS[branch])


_STATUS = "json_extract_string(properties, '$.status')"
_XY = "round(lng, 6) AS lng, round(lat, 6) AS lat"


def xy():
    return F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat")


FILTER = {"op": "and", "args": [{"op": "in", "args": [{"property": "status"}, ["F", "O"]]}, {"op": ">", "args": [{"property": "cust"}, 100]}, {"op": "not", "args": [{"op": "like", "args": [{"property": "priority"}, "1-%"]}]}]}


# ---- snapshots -------------------------------------------------------------------------------


@query(with_fixture(f"""SELECT {_STATUS} AS status, count(*) AS n, round(sum(lng), 4) AS sum_lng, round(avg(lat), 6) AS avg_lat FROM r
WHERE operation <> 'delete' AND {_STATUS} IN ('F', 'O') AND json_extract_string(properties, '$.cust')::DOUBLE > 100 AND json_extract_string(properties, '$.priority') NOT LIKE '1-%' GROUP BY 1""", (5, "r")))
def snapshot_stats(spark, sf):
    rows = _snap(spark, sf).filter(to_column(FILTER)).withColumn("status", C.prop("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("lng"), 4).alias("sum_lng"), F.round(F.avg("lat"), 6).alias("avg_lat"))


@query(with_fixture(f"SELECT feature_id, changeset_id, {_STATUS} AS status, {_XY} FROM r WHERE operation <> 'delete'", (3, "r")))
def branch_snapshot(spark, sf):
    return _snap(spark, sf, "main").select("feature_id", "changeset_id", C.prop("status").alias("status"), *xy())


@query(with_fixture("SELECT 'main' AS branch, count(*) AS n, sum(feature_id)::BIGINT AS ids FROM m WHERE operation <> 'delete' UNION ALL SELECT 'fork', count(*), sum(feature_id)::BIGINT FROM k WHERE operation <> 'delete'", (3, "m"), (5, "k")))
def all_branches_view(spark, sf):
    rows = snapshot.all_branches(versions(spark, sf), changesets(spark), branches(spark))
    return rows.groupBy("branch").agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


@query(with_fixture(f"SELECT feature_id, {_XY} FROM r WHERE operation <> 'delete' AND feature_id > 500 ORDER BY feature_id LIMIT 100", (5, "r")))
def keyset_page(spark, sf):
    return snapshot.page(_snap(spark, sf), cursor=500, limit=100).select("feature_id", *xy())


@query(with_fixture(f"SELECT feature_id, changeset_id, {_XY} FROM r WHERE operation <> 'delete'", (2, "r")))
def time_travel(spark, sf):
    return snapshot.time_travel(versions(spark, sf), changesets(spark), "main", 2).select("feature_id", "changeset_id", *xy())


@query(with_fixture("SELECT feature_id, operation, changeset_id FROM r WHERE feature_id % 100 = 0", (4, "r")))
def contents_at_changeset(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("feature_id")).filter("feature_id % 100 = 0")
    return snapshot.resolve(versions(spark, sf), changesets(spark), 4).join(ids, "feature_id", "left_semi").select("feature_id", "operation", "changeset_id")


@query(with_fixture("SELECT feature_id, operation, changeset_id FROM r", (4, "r")))
def contents_at_changeset_all(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("feature_id"))
    return snapshot.resolve(versions(spark, sf), changesets(spark), 4).join(ids, "feature_id", "left_semi").select("feature_id", "operation", "changeset_id")


@query("SELECT * FROM (VALUES (5::BIGINT, 0), (4, 1), (2, 2), (1, 3)) t(id, depth)")
def branch_history(spark, sf):
    return history.log(changesets(spark), HEADS["fork"]).select("id", "depth")


@query("SELECT 2::BIGINT AS id, 2::BIGINT AS created_at")
def merge_base(spark, sf):
    return history.merge_base(changesets(spark), HEADS["main"], HEADS["fork"])


@query(with_fixture("SELECT count(*) AS n FROM r WHERE operation <> 'delete'", (5, "r")))
def feature_count(spark, sf):
    return _snap(spark, sf).agg(F.count("*").alias("n"))


@query(with_fixture("""SELECT version_id, feature_id FROM (SELECT version_id, feature_id, changeset_id,
row_number() OVER (PARTITION BY feature_id, changeset_id IN (1, 2, 3) ORDER BY changeset_id DESC, version_id DESC) AS n FROM fv) WHERE n = 1 OR changeset_id NOT IN (1, 2, 3)"""))
def compaction(spark, sf):
    own = changesets(spark).filter("branch = 'main'").select("id")
    return snapshot.compact(versions(spark, sf), own, keep=1).select("version_id", "feature_id")


# ---- diff and merge --------------------------------------------------------------------------


@query(with_fixture(f"""SELECT feature_id, operation, {_XY} FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY changeset_id DESC, version_id DESC) AS n
FROM fv WHERE changeset_id IN (4, 5)) WHERE n = 1"""))
def branch_diff(spark, sf):
    return merging.diff(versions(spark, sf), changesets(spark), HEADS["main"], HEADS["fork"]).select("feature_id", "operation", *xy())


@query(with_fixture("""SELECT choice, count(*) AS n, sum(feature_id)::BIGINT AS ids FROM (
SELECT b.feature_id, CASE WHEN t.op IS NULL THEN CASE WHEN o.op = 'delete' AND r.operation = 'delete' THEN 'nothing' ELSE 'ours' END
  WHEN o.op IS NULL THEN 'theirs' WHEN o.op = 'delete' AND t.op = 'delete' THEN 'ours' ELSE 'delete_modify' END AS choice
FROM (SELECT DISTINCT feature_id FROM fv WHERE changeset_id IN (3, 4, 5)) b
LEFT JOIN (SELECT feature_id, 'delete' AS op FROM fv WHERE changeset_id = 3) o USING (feature_id)
LEFT JOIN (SELECT feature_id, CASE WHEN max(changeset_id) = 5 THEN 'delete' ELSE 'update' END AS op FROM fv WHERE changeset_id IN (4, 5) GROUP BY 1) t USING (feature_id)
LEFT JOIN r USING (feature_id)) GROUP BY 1""", (2, "r")))
def merge_preview(spark, sf):
    choices = merging.merge_choices(versions(spark, sf), changesets(spark), HEADS["main"], HEADS["fork"])
    return choices.groupBy("choice").agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


@query(with_fixture("""SELECT feature_id, CASE feature_id % 2 WHEN 0 THEN 'theirs' ELSE 'delete' END AS strategy, CASE WHEN feature_id % 2 = 1 THEN 'delete' ELSE t.op END AS operation
FROM (SELECT feature_id FROM fv WHERE changeset_id = 3) o JOIN (SELECT feature_id, CASE WHEN max(changeset_id) = 5 THEN 'delete' ELSE 'update' END AS op FROM fv WHERE changeset_id IN (4, 5) GROUP BY 1) t USING (feature_id) WHERE t.op <> 'delete'"""))
def resolved_conflicts(spark, sf):
    v, c = versions(spark, sf), changesets(spark)
    choices = merging.merge_choices(v, c, HEADS["main"], HEADS["fork"])
    how = table(spark, sf, "orders").select(F.col("o_orderkey").alias("feature_id"), F.when(F.col("o_orderkey") % 2 == 0, "theirs").otherwise("delete").alias("strategy"))
    ours, theirs = merging.diff(v, c, 2, HEADS["main"]), merging.diff(v, c, 2, HEADS["fork"])
    return merging.resolve_conflicts(choices, how, ours, theirs).select("feature_id", "strategy", "operation")


# ---- filters and statistics ------------------------------------------------------------------


@query(with_fixture(f"SELECT feature_id, {_XY} FROM r WHERE operation <> 'delete' AND lng BETWEEN -60 AND 40 AND lat BETWEEN -10 AND 45.5", (3, "r")))
def bbox_filter(spark, sf):
    return spatial.bbox(_snap(spark, sf, "main"), -60.0, -10.0, 40.0, 45.5).select("feature_id", *xy())


@query(with_fixture(f"SELECT feature_id, {_XY} FROM r WHERE operation <> 'delete' AND lat >= -20 AND lat < 60 AND lng > -80 AND lng < 80 AND lng + lat < 60", (3, "r")))
def polygon_filter(spark, sf):
    shape = {"type": "Polygon", "coordinates": [[[-80, -20], [80, -20], [0, 60], [-80, 60], [-80, -20]]]}
    return _snap(spark, sf, "main").filter(to_column({"op": "s_within", "args": [{"property": "geometry"}, shape]})).select("feature_id", *xy())


@query(with_fixture(f"SELECT {_STATUS} AS status, count(*) AS n, round(sum(lng), 4) AS sum_lng, round(stddev_samp(lat), 6) AS sd_lat, round(min(lng), 6) AS low, round(max(lng), 6) AS high FROM r WHERE operation <> 'delete' GROUP BY 1 HAVING count(*) > 10", (5, "r")))
def grouped_statistics(spark, sf):
    rows = _snap(spark, sf).withColumn("status", C.prop("status"))
    out = statistics.out_statistics(rows, [("count", "feature_id", "n"), ("sum", "lng"), ("stddev", "lat", "sd_lat"), ("min", "lng", "low"), ("max", "lng", "high")], ["status"], having=F.col("n") > 10)
    return out.select("status", "n", F.round("sum_lng", 4).alias("sum_lng"), *[F.round(c, 6).alias(c) for c in ("sd_lat", "low", "high")])


@query(with_fixture(f"SELECT DISTINCT {_STATUS} AS status, json_extract_string(properties, '$.priority') AS priority FROM r WHERE operation <> 'delete'", (5, "r")))
def distinct_values(spark, sf):
    rows = _snap(spark, sf).select(C.prop("status").alias("status"), C.prop("priority").alias("priority"))
    return statistics.distinct_values(rows, ["status", "priority"])


@query(with_fixture("SELECT feature_id, (row_number() OVER (ORDER BY feature_id))::BIGINT AS oid FROM r WHERE operation <> 'delete'", (5, "r")))
def object_ids(spark, sf):
    return spatial.object_ids(_snap(spark, sf)).select("feature_id", F.col("oid").cast("long").alias("oid"))


# ---- points ----------------------------------------------------------------------------------

_CUST = "(SELECT c_custkey AS feature_id, ((c_nationkey * 7919 + c_custkey * 31) % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS lng, ((c_custkey * 104729) % 17000)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS lat, c_mktsegment AS seg FROM customer)"
_SUPP = "(SELECT s_suppkey AS feature_id, ((s_nationkey * 7919 + s_suppkey * 31) % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS lng, ((s_suppkey * 104729) % 17000)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS lat FROM supplier)"


def _points(spark: SparkSession, sf: str, name: str, p: str) -> DataFrame:
    key = f"{p}_{'custkey' if p == 'c' else 'suppkey'}"
    d = table(spark, sf, name)
    lng = ((F.col(f"{p}_nationkey") * 7919 + F.col(key) * 31) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)
    lat = place(key, key)[1]
    return d.select(F.col(key).alias("feature_id"), lng.alias("lng"), lat.alias("lat"), *([F.col("c_mktsegment").alias("seg")] if p == "c" else []))


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(12742000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))))"


@query(f"WITH p AS {_CUST}, q AS (SELECT * FROM p WHERE feature_id = 7) SELECT feature_id, metres FROM (SELECT p.feature_id, round({_hav('q.lng', 'q.lat', 'p.lng', 'p.lat')}, 3) AS metres, sqrt(pow(p.lng - q.lng, 2) + pow(p.lat - q.lat, 2)) AS d FROM p, q WHERE p.feature_id <> 7 ORDER BY d, p.feature_id LIMIT 5)")
def nearest_neighbours(spark, sf):
    return spatial.nearest(_points(spark, sf, "customer", "c"), 7, 5).select("feature_id", F.round("metres", 3).alias("metres"))


@query(f"WITH a AS {_SUPP}, b AS {_CUST} SELECT a.feature_id AS a, b.feature_id AS b, round(sqrt(pow(a.lng - b.lng, 2) + pow(a.lat - b.lat, 2)), 6) AS d FROM a JOIN b ON abs(a.lng - b.lng) <= 2.5 AND abs(a.lat - b.lat) <= 2.5 WHERE sqrt(pow(a.lng - b.lng, 2) + pow(a.lat - b.lat, 2)) <= 2.5::DOUBLE")
def proximity_join(spark, sf):
    return spatial.within_distance(_points(spark, sf, "supplier", "s"), _points(spark, sf, "customer", "c"), 2.5).select("a", "b", F.round("d", 6).alias("d"))


@query(f"WITH p AS {_CUST} SELECT seg AS key, count(*) AS n, round(avg(lng), 6) AS cx, round(avg(lat), 6) AS cy FROM p GROUP BY 1")
def dissolve(spark, sf):
    return spatial.dissolve(_points(spark, sf, "customer", "c"), F.col("seg")).select("key", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"WITH p AS {_CUST} SELECT seg, round(min(lng), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lng), 6) AS xmax, round(max(lat), 6) AS ymax, count(*) AS n FROM p GROUP BY 1")
def extent(spark, sf):
    e = spatial.extent(_points(spark, sf, "customer", "c"), ("seg",))
    return e.select("seg", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], "n")


@query(f"WITH p AS {_CUST}, c AS (SELECT avg(lng) AS x, avg(lat) AS y FROM p), d AS (SELECT feature_id, sqrt(pow(lng - x, 2) + pow(lat - y, 2)) AS distance FROM p, c) SELECT feature_id, round(distance, 6) AS distance FROM d WHERE distance > 1.5 * (SELECT stddev_samp(distance) FROM d)")
def anomalies(spark, sf):
    return spatial.anomalies(_points(spark, sf, "customer", "c"), 1.5).select("feature_id", F.round("distance", 6).alias("distance"))


@query(f"WITH p AS {_CUST} SELECT (least(greatest(floor((lat + 90) / 180 * 128), 0), 127) * 128 + least(greatest(floor((lng + 180) / 360 * 128), 0), 127))::BIGINT AS cell, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, cell LIMIT 500")
def grid_counts(spark, sf):
    return spatial.grid_counts(_points(spark, sf, "customer", "c"), 7)


@query(f"""WITH RECURSIVE p AS {_CUST}, n AS (SELECT a.feature_id AS a, b.feature_id AS b FROM p a JOIN p b ON abs(a.lng - b.lng) <= 1.5 AND abs(a.lat - b.lat) <= 1.5 WHERE sqrt(pow(a.lng - b.lng, 2) + pow(a.lat - b.lat, 2)) <= 1.5::DOUBLE),
c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3), l AS (SELECT n.a, n.b FROM n WHERE n.a IN (FROM c) AND n.b IN (FROM c)), w(id, root) AS (SELECT a, a FROM c UNION SELECT l.b, w.root FROM w JOIN l ON l.a = w.id),
r AS (SELECT id, min(root) AS cluster FROM w GROUP BY 1) SELECT n.b AS feature_id, min(cluster) AS cluster FROM n JOIN r ON n.a = r.id GROUP BY 1""")
def dbscan(spark, sf):
    return spatial.dbscan(_points(spark, sf, "customer", "c"), 1.5, 3)


@query(f"WITH p AS {_SUPP} SELECT feature_id, round(6378137.0::DOUBLE * radians(lng), 3) AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM p")
def web_mercator(spark, sf):
    x, y = C.mercator(F.col("lng"), F.col("lat"))
    return _points(spark, sf, "supplier", "s").select("feature_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# ---- networks --------------------------------------------------------------------------------

#: A bound on edges; the _all queries at the end of this file do without.
_NEAR = " AND s_nationkey - c_nationkey <= 3"
_EDGES = "(SELECT c_nationkey::BIGINT AS from_id, s_nationkey::BIGINT AS to_id, round(avg(l_quantity), 4) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey AND s_nationkey - c_nationkey <= 3 GROUP BY 1, 2)"


def _edges(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    l, o, c, s = (table(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    rows = rows.filter("c_nationkey < s_nationkey" + ("" if every else _NEAR))
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("from_id"), F.col("s_nationkey").cast("long").alias("to_id")).agg(F.round(F.avg("l_quantity"), 4).alias("cost"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, b AS (SELECT from_id, to_id, cost FROM e UNION ALL SELECT to_id, from_id, cost FROM e),
w(id, cost, hops) AS (SELECT 0::BIGINT, 0::DOUBLE, 0 UNION SELECT id, min(cost), hops + 1 FROM (SELECT to_id AS id, w.cost + b.cost AS cost, hops FROM w JOIN b ON b.from_id = w.id WHERE hops < 24) GROUP BY id, hops)
SELECT id, round(min(cost), 4) AS cost FROM w GROUP BY 1""")
def shortest_paths(spark, sf, every=False):
    return network.costs_from(_edges(spark, sf, every), 0).select("id", F.round("cost", 4).alias("cost"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, b AS (SELECT from_id, to_id, cost FROM e UNION ALL SELECT to_id, from_id, cost FROM e),
w(id, cost, hops) AS (SELECT 0::BIGINT, 0::DOUBLE, 0 UNION SELECT id, min(cost), hops + 1 FROM (SELECT to_id AS id, w.cost + b.cost AS cost, hops FROM w JOIN b ON b.from_id = w.id WHERE hops < 24) GROUP BY id, hops)
SELECT id, round(min(cost), 4) AS cost FROM w GROUP BY 1 HAVING min(cost) <= 60""")
def service_area(spark, sf, every=False):
    return network.costs_from(_edges(spark, sf, every), 0, max_cost=60.0).select("id", F.round("cost", 4).alias("cost"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, b AS (SELECT from_id, to_id FROM e UNION SELECT to_id, from_id FROM e),
w(id, root) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT b.to_id, w.root FROM w JOIN b ON b.from_id = w.id)
SELECT id, min(root) AS component FROM w GROUP BY 1""")
def network_components(spark, sf, every=False):
    return network.components(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), _edges(spark, sf, every))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def isolated_junctions(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("from_id"), F.col("o_custkey").alias("to_id"), F.lit(1.0).alias("cost"))
    return network.isolated(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), edges)


# ---- vectors, trajectories, verticals, feed ---------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))


@query("WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE id = 3) SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q WHERE list_cosine_similarity(v, q) > 0.2 ORDER BY id LIMIT 10")
def similar_features(spark, sf):
    v = _vectors(spark, sf)
    return similarity.similar_to(v, v.filter("id = 3").first().vec, 0.2, 10).select("id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS a FROM v, range(1, 65) t(i) GROUP BY i)),
d AS (SELECT id, round(1 - list_cosine_similarity(v, c), 9) AS d FROM v, m), b AS (SELECT id, ntile(5) OVER (ORDER BY d, id) AS bucket FROM d) SELECT bucket::INT AS bucket, count(*) AS n FROM b GROUP BY 1""")
def embedding_buckets(spark, sf):
    return similarity.ntile_buckets(_vectors(spark, sf), 64, 5).select("bucket", "n")


def _fixes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select(F.col("user_id").alias("traj"), ts.alias("ts"), F.col("event_id").alias("seq"), (F.col("event_id") % 3600).cast("double").alias("l0"), "value").select("traj", "ts", "seq", (F.col("l0") / F.lit(10.0) - F.lit(180.0)).alias("lng"), ((F.col("seq") * 7 % 1700).cast("double") / F.lit(10.0) - F.lit(85.0)).alias("lat"))


_SEG = f"""WITH f AS (SELECT user_id AS traj, epoch_us(ts)::DOUBLE / 1e6 AS ts, event_id AS seq, (event_id % 3600)::DOUBLE / 10.0::DOUBLE - 180.0::DOUBLE AS lng, (event_id * 7 % 1700)::DOUBLE / 10.0::DOUBLE - 85.0::DOUBLE AS lat FROM events),
s AS (SELECT *, lead(ts) OVER w AS ts2, lead(lng) OVER w AS lng2, lead(lat) OVER w AS lat2 FROM f WINDOW w AS (PARTITION BY traj ORDER BY ts, seq)),
g AS (SELECT *, {_hav('lng', 'lat', 'lng2', 'lat2')} AS m, ts2 - ts AS sec FROM s WHERE ts2 IS NOT NULL) """


@query(_SEG + "SELECT traj, round(sum(m), 1) AS metres, round(sum(m) / sum(sec), 4) AS mean_speed, round(max(CASE WHEN sec > 0 THEN m / sec END), 3) AS max_speed FROM g GROUP BY 1")
def trajectory_summary(spark, sf):
    return trajectory.summary(_fixes(spark, sf)).select("traj", F.round("metres", 1).alias("metres"), F.round("mean_speed", 4).alias("mean_speed"), F.round("max_speed", 3).alias("max_speed"))


@query(_SEG + ", t AS (SELECT floor(avg(ts)) AS t FROM f) SELECT traj, round(lng + (t - ts) / sec * (lng2 - lng), 6) AS lng, round(lat + (t - ts) / sec * (lat2 - lat), 6) AS lat FROM g, t WHERE ts <= t AND ts2 > t")
def trajectory_position(spark, sf):
    f = _fixes(spark, sf)
    return trajectory.position_at(f, f.agg(F.floor(F.avg("ts"))).first()[0]).select("traj", *xy())


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'no_data' WHEN p_size / 50.0 > 0.6 THEN 'healthy' WHEN p_size / 50.0 > 0.3 THEN 'moderate_stress' ELSE 'severe_stress' END AS ndvi,
round(69.55 + 26.16 * log10(900 + p_size) - 13.82 * log10(30.0) + (44.9 - 6.55 * log10(30.0)) * log10(p_retailprice / 100), 6) AS loss FROM part""")
def vertical_models(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", C.ndvi_class(size / 50.0).alias("ndvi"), F.round(C.urban_path_loss(size + 900.0, F.lit(30.0), price / 100.0), 6).alias("loss"))


@query("WITH f AS (SELECT event_id, event_type, (row_number() OVER (ORDER BY ts, event_id))::BIGINT AS sequence_id FROM events) SELECT sequence_id, event_id, event_type FROM f WHERE sequence_id > 100 AND sequence_id <= 400")
def change_window(spark, sf):
    order = F.struct(F.col("ts"), F.col("event_id"))
    feed = table(spark, sf, "events").select("event_id", "event_type", order.alias("feature_id"))
    return change_feed.window(spatial.object_ids(feed).withColumnRenamed("oid", "sequence_id"), 100, 400).select(F.col("sequence_id").cast("long").alias("sequence_id"), "event_id", "event_type")


@query(f"""WITH w AS (SELECT lower(c_name) AS name, c_custkey FROM customer) SELECT c_custkey, upper(md5(name)) AS digest, {", ".join(f"round(('0x' || substr(sha256(name || '{i}'), {2 * (i % 32) + 1}, 2))::BIGINT / 255.0::DOUBLE, 9) AS v{i}" for i in (0, 1, 33))} FROM w""")
def text_embeddings(spark, sf):
    v = C.text_embedding(F.col("name"))
    rows = table(spark, sf, "customer").select("c_custkey", F.lower("c_name").alias("name"))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)  # names are a small file, their vectors much work
    return rows.select("c_custkey", F.upper(F.md5(F.col("name").cast("binary"))).alias("digest"), *[F.round(v[i], 9).alias(f"v{i}") for i in (0, 1, 33)])


@query("""SELECT n_nationkey::INT AS dataset, n_name AS name FROM nation WHERE n_regionkey = 1 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 97 = 5)""")
def visible_datasets(spark, sf, every=False):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("dataset"), F.col("n_name").alias("name"), "n_regionkey")
    grants = table(spark, sf, "customer").filter("true" if every else "c_custkey % 97 = 5").select(F.col("c_nationkey").cast("int").alias("dataset"))
    open_ones, closed = n.filter("n_regionkey = 1"), n.filter("n_regionkey <> 1")
    return open_ones.union(closed.join(grants, "dataset", "left_semi").select(n.columns)).select("dataset", "name")


@query("""SELECT c_custkey AS feature_id, 'forward' AS direction, o_orderkey AS related FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey <= 40
UNION ALL SELECT o_orderkey, 'backward', o_custkey FROM orders WHERE o_custkey <= 40 AND o_custkey IN (SELECT c_custkey FROM customer)""")
def related_features(spark, sf):
    return _related(spark, sf, table(spark, sf, "customer").filter("c_custkey <= 40"))


@query("""SELECT c_custkey AS feature_id, 'forward' AS direction, o_orderkey AS related FROM customer JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey, 'backward', o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def related_features_all(spark, sf):
    return _related(spark, sf, table(spark, sf, "customer"))


def _related(spark: SparkSession, sf: str, customers: DataFrame) -> DataFrame:
    links = customers.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    out = links.select(F.col("c_custkey").alias("feature_id"), F.lit("forward").alias("direction"), F.col("o_orderkey").alias("related"))
    return out.union(links.select("o_orderkey", F.lit("backward"), "c_custkey"))


@query(f"""WITH p AS {_CUST}, q AS (SELECT p.*, c_acctbal AS price FROM p JOIN customer ON c_custkey = feature_id), d AS (SELECT *, {_hav('0.0::DOUBLE', '0.0::DOUBLE', 'lng', 'lat')} AS metres FROM q),
t AS (SELECT * FROM d WHERE metres <= 3000000 ORDER BY metres, feature_id LIMIT 50) SELECT count(*) AS n, round(avg(price), 4) AS mean, (list(price ORDER BY price))[(count(*) // 2 + 1)::BIGINT] AS median, min(price) AS low, max(price) AS high FROM t""")
def comparables(spark, sf):
    price = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), F.col("c_acctbal").alias("price"))
    d = _points(spark, sf, "customer", "c").join(price, "feature_id").withColumn("metres", C.haversine(F.lit(0.0), F.lit(0.0), F.col("lng"), F.col("lat")))
    near = d.filter("metres <= 3000000").orderBy("metres", "feature_id").limit(50)
    prices = F.array_sort(F.collect_list("price"))
    return near.agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"), F.element_at(prices, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"), F.min("price").alias("low"), F.max("price").alias("high"))


# ---- tiles, grids, rasters, routes ------------------------------------------------------------

_TILE = f"""t AS (SELECT feature_id, (lng + 180.0::DOUBLE) / 360.0::DOUBLE * 64.0::DOUBLE AS x, (1.0::DOUBLE - ln(tan(phi) + 1.0::DOUBLE / cos(phi)) / pi()) / 2.0::DOUBLE * 64.0::DOUBLE AS y
FROM (SELECT *, radians(least(greatest(lat, -{grids.MAX_LATITUDE}::DOUBLE), {grids.MAX_LATITUDE}::DOUBLE)) AS phi FROM p)), u AS (SELECT *, least(greatest(floor(x), 0), 63)::BIGINT AS tx, least(greatest(floor(y), 0), 63)::BIGINT AS ty FROM t)"""


@query(f"WITH p AS {_CUST}, {_TILE} SELECT feature_id, tx, ty, floor((x - tx) * 4096)::BIGINT AS px, floor((y - ty) * 4096)::BIGINT AS py FROM u")
def tile_points(spark, sf):
    return grids.tile_points(_points(spark, sf, "customer", "c"), 6)


@query(f"WITH p AS {_CUST}, {_TILE} SELECT tx, ty, count(*) AS n FROM u GROUP BY 1, 2")
def tile_counts(spark, sf):
    return grids.tile_counts(_points(spark, sf, "customer", "c"), 6)


def _cell(zoom: int) -> str:
    n = 1 << zoom
    return f"(least(greatest(floor((lat + 90) / 180 * {n}), 0), {n - 1}) * {n} + least(greatest(floor((lng + 180) / 360 * {n}), 0), {n - 1}))::BIGINT"


@query(f"WITH p AS {_SUPP}, c AS (SELECT DISTINCT {_cell(5)} AS cell FROM p) SELECT DISTINCT cell, ((cell // 32 + dy) * 32 + (cell % 32 + dx + 32) % 32)::BIGINT AS neighbour FROM c, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE cell // 32 + dy BETWEEN 0 AND 31")
def grid_disk(spark, sf):
    cells = _points(spark, sf, "supplier", "s").select(C.grid_cell(F.col("lng"), F.col("lat"), 5).alias("cell")).distinct()
    return grids.grid_disk(cells, 5, 1)


@query(f"""WITH p AS {_SUPP}, c AS {_CUST}, t AS ({" UNION ALL ".join(f"SELECT {z} AS zoom, {_cell(z)} AS cell, count(*) AS value FROM c GROUP BY 2" for z in (2, 4, 7))}),
f AS ({" UNION ALL ".join(f"SELECT feature_id, t.zoom, value FROM p JOIN t ON t.zoom = {z} AND t.cell = {_cell(z)}" for z in (2, 4, 7))})
SELECT p.feature_id, max(zoom)::INT AS zoom, arg_max(value, zoom) AS value FROM p LEFT JOIN f USING (feature_id) GROUP BY 1""")
def raster_values(spark, sf):
    c = _points(spark, sf, "customer", "c")
    level = lambda z: c.groupBy(F.lit(z).alias("zoom"), C.grid_cell(F.col("lng"), F.col("lat"), z).alias("cell")).agg(F.count("*").alias("value"))
    return grids.raster_values(_points(spark, sf, "supplier", "s"), level(2).union(level(4)).union(level(7)), [2, 4, 7])


@query(f"WITH p AS {_CUST} SELECT a.feature_id AS a, b.feature_id AS b, round({_hav('a.lng', 'a.lat', 'b.lng', 'b.lat')}, 3) AS metres FROM p a JOIN p b ON a.feature_id < b.feature_id WHERE a.feature_id IN (3, 7, 11, 20) AND b.feature_id IN (3, 7, 11, 20)")
def distance_matrix(spark, sf):
    return spatial.distance_matrix(_points(spark, sf, "customer", "c"), [3, 7, 11, 20]).select("a", "b", F.round("metres", 3).alias("metres"))


@query(f"WITH p AS {_SUPP} SELECT feature_id, i::INT AS i, round(lng + 5000 / 111320.0::DOUBLE * cos(i * 2 * pi() / 32), 8) AS x, round(lat + 5000 / 111320.0::DOUBLE * sin(i * 2 * pi() / 32), 8) AS y FROM p, range(0, 33) t(i)")
def circle_rings(spark, sf):
    rings = spatial.circles(_points(spark, sf, "supplier", "s"), 5000.0).select("feature_id", F.posexplode("ring").alias("i", "at"))
    return rings.select("feature_id", "i", F.round("at.x", 8).alias("x"), F.round("at.y", 8).alias("y"))


_ROUTE = f"""WITH p AS {_CUST}, v AS (SELECT feature_id % 50 AS route, feature_id AS seq, lng, lat FROM p), l AS (SELECT *, lag(lng) OVER w AS x, lag(lat) OVER w AS y FROM v WINDOW w AS (PARTITION BY route ORDER BY seq)),
s AS (SELECT *, CASE WHEN x IS NULL THEN 0 ELSE {_hav('x', 'y', 'lng', 'lat')} END AS step FROM l), m AS (SELECT *, sum(step) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING) AS measure FROM s) """


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf, "customer", "c").select((F.col("feature_id") % 50).alias("route"), F.col("feature_id").alias("seq"), "lng", "lat")


@query(_ROUTE + "SELECT route, count(*) AS n, round(max(measure), 1) AS total_length FROM m GROUP BY 1")
def route_lengths(spark, sf):
    return linear.route_lengths(_routes(spark, sf)).select("route", "n", F.round("total_length", 1).alias("total_length"))


@query(_ROUTE + """, e AS (SELECT s_suppkey % 50 AS route, s_suppkey AS event, s_suppkey * 100003.5::DOUBLE AS goal FROM supplier),
g AS (SELECT *, lead(measure) OVER w AS m2, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM m WINDOW w AS (PARTITION BY route ORDER BY seq))
SELECT route, event, round(lng + (goal - measure) / (m2 - measure) * (x2 - lng), 6) AS lng, round(lat + (goal - measure) / (m2 - measure) * (y2 - lat), 6) AS lat FROM e JOIN g USING (route) WHERE measure <= goal AND m2 > goal""")
def locate_along(spark, sf):
    events = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("route"), F.col("s_suppkey").alias("event"), (F.col("s_suppkey") * F.lit(100003.5)).alias("measure"))
    return linear.locate_along(_routes(spark, sf), events).select("route", "event", *xy())


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, w(id, depth) AS (SELECT 2::BIGINT, 0 UNION SELECT to_id, depth + 1 FROM w JOIN e ON from_id = id WHERE depth < 3) SELECT id, min(depth)::INT AS depth FROM w GROUP BY 1""")
def network_trace(spark, sf, every=False):
    return network.trace(_edges(spark, sf, every), 2, 3)


# ---- access, schemas, search -----------------------------------------------------------------


@query("""WITH b AS (SELECT n_nationkey AS branch, n_regionkey AS dataset FROM nation), lv AS (SELECT * FROM (VALUES ('read', 1), ('write', 2), ('admin', 3)) t(permission, level)),
dg AS (SELECT s_nationkey % 5 AS dataset, s_suppkey AS usr, CASE s_suppkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'admin' END AS permission FROM supplier),
bg AS (SELECT c_nationkey AS branch, c_custkey AS usr, CASE c_custkey % 2 WHEN 0 THEN 'read' ELSE 'admin' END AS permission FROM customer WHERE c_custkey % 13 = 0 AND c_nationkey % 2 = 0),
a AS (SELECT * FROM bg UNION ALL SELECT branch, usr, permission FROM b JOIN dg USING (dataset) WHERE branch NOT IN (SELECT branch FROM bg)) SELECT branch, usr AS "user", max(level)::INT AS level FROM a JOIN lv USING (permission) GROUP BY 1, 2""")
def access_levels(spark, sf, every=False):
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("branch"), F.col("n_regionkey").alias("dataset"))
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    grants = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("dataset"), s.alias("user"), F.when(s % 3 == 0, "read").when(s % 3 == 1, "write").otherwise("admin").alias("permission"))
    own = table(spark, sf, "customer").filter("c_nationkey % 2 = 0" + ("" if every else " AND c_custkey % 13 = 0")).select(F.col("c_nationkey").alias("branch"), k.alias("user"), F.when(k % 2 == 0, "read").otherwise("admin").alias("permission"))
    return governance.access_levels(b, grants, own)


@query(with_fixture("""SELECT feature_id, 'status' AS field, 'allowed' AS error FROM fv WHERE operation <> 'delete' AND json_extract_string(properties, '$.status') NOT IN ('F', 'O')
UNION ALL SELECT feature_id, 'cust', CASE WHEN json_extract_string(properties, '$.cust')::DOUBLE < 10 THEN 'min' ELSE 'max' END FROM fv WHERE operation <> 'delete' AND json_extract_string(properties, '$.cust')::DOUBLE NOT BETWEEN 10 AND 100
UNION ALL SELECT feature_id, 'name', 'type' FROM fv WHERE operation <> 'delete' UNION ALL SELECT feature_id, 'owner', 'required' FROM fv WHERE operation <> 'delete' AND feature_id % 50 = 0"""))
def schema_errors(spark, sf):
    rows = versions(spark, sf).filter("operation <> 'delete'")
    fields = [{"name": "status", "allowed": ["F", "O"]}, {"name": "cust", "type": "number", "min": 10, "max": 100}, {"name": "name", "type": "integer"}]
    owner = governance.schema_errors(rows.filter("feature_id % 50 = 0"), [{"name": "owner", "required": True}])
    return governance.schema_errors(rows, fields).union(owner)


@query(with_fixture("""SELECT feature_id, 'status' AS field, 'allowed' AS error FROM fv WHERE operation <> 'delete' AND json_extract_string(properties, '$.status') NOT IN ('F', 'O')
UNION ALL SELECT feature_id, 'cust', CASE WHEN json_extract_string(properties, '$.cust')::DOUBLE < 10 THEN 'min' ELSE 'max' END FROM fv WHERE operation <> 'delete' AND json_extract_string(properties, '$.cust')::DOUBLE NOT BETWEEN 10 AND 100
UNION ALL SELECT feature_id, 'name', 'type' FROM fv WHERE operation <> 'delete' UNION ALL SELECT feature_id, 'owner', 'required' FROM fv WHERE operation <> 'delete'"""))
def schema_errors_all(spark, sf):
    fields = [{"name": "status", "allowed": ["F", "O"]}, {"name": "cust", "type": "number", "min": 10, "max": 100}, {"name": "name", "type": "integer"}, {"name": "owner", "required": True}]
    return governance.schema_errors(versions(spark, sf).filter("operation <> 'delete'"), fields)


@query(with_fixture("SELECT feature_id FROM r WHERE operation <> 'delete' AND json_extract_string(properties, '$.priority') ILIKE '%urgent%'", (3, "r")))
def property_search(spark, sf):
    return governance.property_search(_snap(spark, sf, "main"), "priority", "uRGent").select("feature_id")


# ---- the same over all edges and grants --------------------------------------------------------


def _whole(f: Callable[..., DataFrame], bound: str) -> None:
    """Registers f over every edge or grant as f_all; its SQL is that of f without the bound."""
    QUERIES[f"{f.__name__}_all"] = lambda spark, sf: f(spark, sf, every=True)
    ORACLE_SQL[f"{f.__name__}_all"] = ORACLE_SQL[f.__name__].replace(bound, "")


for _f in (shortest_paths, service_area, network_components, network_trace):
    _whole(_f, _NEAR)
_whole(visible_datasets, " AND c_custkey % 97 = 5")
_whole(access_levels, "c_custkey % 13 = 0 AND ")


from . import more_queries, shape_queries  # noqa: E402, F401  register their own
