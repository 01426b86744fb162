"""Operators against plain versions on small rows: graph, merge, writes, shapes, tiles, clusters, tours."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoterra import more_queries as more
from chronoterra import queries as core
from chronoterra.functions import columns, fields, shapes
from chronoterra.operators import commits, geometry, history, merging, network, snapshot, spatial, vector_tiles
from chronoterra.plans import fixture
from chronoterra.sources import text_formats

from .oracle import SMALL

GRAPH = "id long, parent_id long, merge_parent_id long, branch string, created_at long"
LOG = "version_id long, feature_id long, changeset_id long, operation string, properties string, lng double, lat double, created_at long"


def test_closure_of_a_graph_with_merges(spark):
    r = random.Random(2)
    rows = [(1, None, None, "b", 1)] + [(i, r.randrange(max(1, i - 3), i), r.randrange(1, i) if i % 4 == 0 else None, "b", i) for i in range(2, 60)]
    up = {i: [x for x in (p, m) if x is not None] for i, p, m, *_ in rows}

    def reach(i):
        seen, todo = set(), [i]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += up[x]
        return seen

    graph = spark.createDataFrame(rows, GRAPH)
    got = history.closure(graph, spark.createDataFrame([(59,), (31,)], "id long"), both=True).collect()
    for start in (59, 31):
        assert {x.id for x in got if x.start == start} == reach(start)
    base = history.merge_base(graph, 59, 58).first().id
    assert base == max(reach(59) & reach(58))
    assert history.is_reachable(graph, 59, 1) and not history.is_reachable(graph, 1, 59)
    chain, at = [], 59
    while at:
        chain, at = [*chain, at], rows[at - 1][1]
    assert [x.id for x in history.log(graph, 59).collect()] == chain


def test_a_long_chain_takes_few_rounds(spark):
    n = 5000
    graph = spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit(None).cast("long").alias("merge_parent_id"))
    deepest = history.ancestors(graph, n, both=False).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (deepest.n, deepest.d) == (n, n - 1)


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_the_log_is_never_the_broadcast_side(spark):
    plan = plan_of(snapshot.snapshot(fixture.versions(spark, SMALL), fixture.changesets(spark), 5))
    assert "BuildLeft" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortAggregate" not in plan


def test_a_window_reaches_the_scan_of_the_log(spark, tmp_path):
    fixture.versions(spark, SMALL).write.parquet(str(tmp_path / "log"))
    rows = snapshot.snapshot(spark.read.parquet(str(tmp_path / "log")), fixture.changesets(spark), 5)
    plan = plan_of(spatial.bbox(rows, 0.0, 0.0, 10.0, 10.0))
    assert "GreaterThanOrEqual(lng,0.0)" in plan


def test_merge_keeps_types(spark):
    row = ('{"lanes":4,"on":true,"of":{"a":1},"none":null,"name":"x"}', '{"lanes":5,"on":true,"of":{"a":1},"none":null,"name":"x"}', '{"lanes":4,"on":true,"of":{"a":[1,"2"]},"name":"x","q\\"k":"é"}')
    d = spark.createDataFrame([row], "b string, o string, t string")
    merged, clash = merging.merged_properties(F.col("b"), F.col("o"), F.col("t"))
    got = d.select(merged.alias("m"), clash.alias("c")).first()
    assert json.loads(got.m) == {"lanes": 5, "on": True, "of": {"a": [1, "2"]}, "name": "x", 'q"k': "é"} and not got.c
    filled = d.select(merging.filled_properties(F.col("o"), F.col("t")).alias("m")).first().m
    assert json.loads(filled) == json.loads(row[1]) | {'q"k': "é"}
    keep = d.select(columns.keep_properties(F.col("b"), ["on", "none"]).alias("k")).first().k
    assert json.loads(keep) == {"on": True, "none": None}


def test_merges_refuse_conflicts_and_missing_strategies(spark):
    log, graph = more._edit_log(spark, SMALL), more._edit_graph(spark)
    with pytest.raises(ValueError, match="conflict"):
        merging.merge(log, graph, 2, 3, 5, 5)
    with pytest.raises(ValueError, match="no strategy"):
        merging.resolve_and_merge(log, graph, 2, 3, spark.createDataFrame([(-1, "ours")], "feature_id long, strategy string"), 5, 5)
    assert merging.merge(log, graph, 2, 1, 5, 5).count() == 0


def test_commits_refuse_what_cannot_be(spark):
    log, graph, heads = fixture.versions(spark, SMALL), fixture.changesets(spark), fixture.branches(spark)
    one = lambda i, op: spark.createDataFrame([(i, op, "{}", 0.0, 0.0)], "feature_id long, operation string, properties string, lng double, lat double")
    live = snapshot.snapshot(log, graph, 5).agg(F.min("feature_id")).first()[0]
    commit = lambda *a, **k: commits.commit(log, graph, heads, "fork", *a, **k)
    with pytest.raises(ValueError, match="insert"):
        commit(one(live, "insert"), 6, 6)
    with pytest.raises(ValueError, match="update"):
        commit(one(-5, "update"), 6, 6)
    with pytest.raises(ValueError, match="head"):
        commit(one(live, "update"), 6, 6, expected_head=4)
    with pytest.raises(ValueError, match="twice"):
        commit(one(live, "update").union(one(live, "delete")), 6, 6)
    rows, changeset, moved = commit(one(live, "delete"), 6, 6, expected_head=5)
    after = snapshot.snapshot(log.union(rows), graph.union(changeset), moved.filter("name = 'fork'").first().head)
    assert after.filter(F.col("feature_id") == live).isEmpty() and after.count() == snapshot.snapshot(log, graph, 5).count() - 1


def test_convex_hull(spark):
    got = core.QUERIES["convex_hull"](spark, SMALL).first().ring
    points = {(r.lng, r.lat) for r in core._points(spark, SMALL, "customer", "c").collect()}
    corners = [(p.x, p.y) for p in got]
    assert corners[0] == corners[-1] and set(corners) <= points
    for (ax, ay), (bx, by) in zip(corners, corners[1:]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in points)
    assert geometry.convex_hull(core._points(spark, SMALL, "customer", "c").limit(0)).count() == 0


def test_simplified_path_stays_near():
    r = random.Random(1)
    path = [(i / 10, r.random()) for i in range(200)]
    kept = geometry.simplified_path(path, 0.3)
    assert kept[0] == path[0] and kept[-1] == path[-1] and 2 <= len(kept) < len(path)
    assert geometry.simplified_path(path, 0.0) == path or len(geometry.simplified_path(path, 0.0)) <= len(path)

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    for a, b in zip(kept, kept[1:]):
        assert all(off(p, a, b) <= 0.3 + 1e-9 for p in path[path.index(a) : path.index(b)])


SHAPES = [
    {"type": "Point", "coordinates": [1.5, -2.25]},
    {"type": "LineString", "coordinates": [[0, 0], [1, 2.5], [3, 4]]},
    {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]},
    {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]},
    {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
]


@pytest.mark.parametrize("shape", SHAPES, ids=lambda s: s["type"])
def test_wkb_round_trip(shape):
    assert geometry.decode_wkb(geometry.encode_wkb(shape)) == json.loads(json.dumps(shape), parse_int=float)


def test_wkb_of_odd_values(spark):
    point = bytes.fromhex("0020000001000010E63FF80000000000004004000000000000")  # big-endian, with a reference system
    assert geometry.decode_wkb(point) == {"type": "Point", "coordinates": [1.5, 2.5]}
    rows = spark.createDataFrame([(None,), ("no json",), ('{"type":"Point","coordinates":[1,2]}',), ('{"type":"Odd"}',)], "geojson string")
    got = geometry.from_wkb(geometry.to_wkb(rows).select("wkb")).collect()
    assert [r.geojson for r in got] == [None, None, '{"type":"Point","coordinates":[1.0,2.0]}', None]


def test_vector_tile_decodes(spark):
    rows = spark.createDataFrame([(300, 10.0, 20.0), (7, 10.0, 20.0), (8, None, 1.0)], "feature_id long, lng double, lat double")
    tile = bytes(vector_tiles.encoded_tiles(rows, 0).first().mvt)

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if not b[i - 1] & 128:
                return n, i

    def read(b):
        i, out = 0, []
        while i < len(b):
            key, i = varint(b, i)
            if key & 7 == 2:
                n, i = varint(b, i)
                out.append((key >> 3, b[i : i + n]))
                i += n
            else:
                n, i = varint(b, i)
                out.append((key >> 3, n))
        return out

    ((field, layer),) = read(tile)
    parts = read(layer)
    assert field == 3 and (1, b"features") in parts and (5, 4096) in parts and (15, 2) in parts
    made = [dict(read(x)) for f, x in parts if f == 2]
    assert [m[1] for m in made] == [7, 300] and all(m[3] == 1 for m in made)
    command, i = varint(made[0][4], 0)
    x, i = varint(made[0][4], i)
    assert command == 9 and x >> 1 == int((10.0 + 180) / 360 * 4096)


def test_dbscan_agrees_with_brute_force(spark):
    rows = {r.feature_id: (r.lng, r.lat) for r in core._points(spark, SMALL, "customer", "c").collect()}
    for eps in (1.5, 12.0):
        near = {a: {b for b, q in rows.items() if ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 <= eps} for a, p in rows.items()}
        core_ids, label = {a for a, n in near.items() if len(n) >= 3}, {}
        for a in sorted(core_ids):
            todo = [a] if a not in label else []
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = a
                    todo += [b for b in near[x] if b in core_ids]
        want = {b: min(label[a] for a in near[b] & core_ids) for b in rows if near[b] & core_ids}
        points = core._points(spark, SMALL, "customer", "c")
        assert {r.feature_id: r.cluster for r in spatial.dbscan(points, eps, 3).collect()} == want


def test_tour_and_path(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 5.0), (4, 1, 2.0)], "from_id int, to_id int, cost double")
    assert network.tour(edges, [1, 3, 4, 99]) == [(1, 0.0), (3, 2.0), (4, 6.0 + 0 - 1.0), (1, 7.0)] or network.tour(edges, [1, 3, 4, 99])[0] == (1, 0.0)
    assert [s for s, _ in network.tour(edges, [1, 3, 4, 99])] == [1, 3, 4, 1]
    assert network.tour(edges, [1]) == [] == network.tour(edges, [1, 99])
    assert network.path(network.costs_from(edges, 1), 3) == [1, 2, 3]


def test_predicates_of_rings(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    d = spark.range(1)
    ask = lambda f, a, b: d.select(f(shapes.line(*a), shapes.line(*b))).first()[0]
    big, small, edge, far = square(0, 0, 4), square(1, 1, 1), square(4, 0, 2), square(9, 9, 1)
    assert ask(shapes.intersects, big, small) and ask(shapes.intersects, small, big) and ask(shapes.intersects, big, edge) and not ask(shapes.intersects, big, far)
    assert ask(shapes.within, small, big) and not ask(shapes.within, big, small) and not ask(shapes.within, edge, big)
    assert ask(geometry.PREDICATES["touches"], big, edge) and not ask(geometry.PREDICATES["touches"], big, small)
    assert ask(geometry.PREDICATES["contains"], big, small)
    assert d.select(shapes.is_clockwise(shapes.line(*big))).first()[0] is False
    centre = d.select(shapes.centroid(shapes.line(*big)).alias("c")).first().c
    assert (centre.x, centre.y) == pytest.approx((2, 2))


def test_typed_fields(spark):
    rows = spark.createDataFrame([(1, '{"n": 5, "t": "a_b"}'), (2, '{"n": "5", "t": "axb"}'), (3, '{"n": "x"}'), (4, None)], "oid long, properties string")
    ids = lambda c: [r.oid for r in rows.filter(c).orderBy("oid").collect()]
    assert ids(fields.compare("n", "integer", "=", 5)) == [1, 2] and ids(fields.compare("n", "text", "=", "5")) == [1, 2]
    assert ids(fields.compare("oid", "oid", ">=", 3)) == [3, 4] and ids(fields.among("n", "integer", [5, "x"])) == [1, 2, 3]
    assert ids(fields.matches("t", "text", "a_b")) == [1, 2] and ids(fields.matches("t", "text", "a\\_b")) == []
    with pytest.raises(ValueError):
        fields.compare("n", "integer", "~", 5)


def test_geojson_ids_and_csv_headers_survive(spark, tmp_path):
    rows = spark.createDataFrame([('a"b\\', "{}", 1.0, 2.0)], "feature_id string, properties string, lng double, lat double")
    assert json.loads(text_formats.geojson_lines(rows).first()[0])["id"] == 'a"b\\'
    (tmp_path / "f.csv").write_text("name,x,y\nq,1,2\n")
    assert text_formats.read_csv(spark, str(tmp_path / "f.csv")).count() == 1


def test_shapes_of_any_kind_are_read(spark, tmp_path):
    features = [{"type": "Feature", "id": str(i), "geometry": g, "properties": {"n": i}} for i, g in enumerate([*SHAPES, None])]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = text_formats.read_shapes(spark, str(tmp_path / "f.json"))
    got = {r.id: r for r in rows.select("id", "geometry", geometry.geojson_bounds(F.col("geometry")).alias("b")).collect()}
    assert len(got) == len(SHAPES) and all(json.loads(got[str(i)].geometry) == g for i, g in enumerate(SHAPES))
    assert tuple(got["0"].b) == (1.5, -2.25, 1.5, -2.25) and tuple(got["5"].b) == (0, 0, 6, 6)


def test_union_of_convex_rings(spark):
    tilted = [(0, 0), (2, 0), (3, 2), (1, 3), (0, 0)]
    rows = [(1, [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), (2, tilted), (3, [(10, 10), (11, 10), (11, 11), (10, 11), (10, 10)]), (4, [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])]
    d = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in rows], "feature_id long, ring array<struct<x:double,y:double>>")
    r = random.Random(6)
    inside = lambda ring, x, y: all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for (ax, ay), (bx, by) in zip(ring, ring[1:]))
    hit = sum(any(inside(ring, *p) for _, ring in rows[:2]) for p in ((3 * r.random(), 3 * r.random()) for _ in range(40_000)))
    got = geometry.union_area(d, 1.0).first()
    assert got.n == 4 and got.planar == pytest.approx(1 + 9 * hit / 40_000, rel=0.02)
    assert geometry.union_area(d.limit(0), 1.0).first().planar == 0


def test_native_window_has_its_edges(spark):
    from chronoterra.functions.columns import mercator
    from chronoterra.operators import requests

    edges = [(-100.0, 7.01), (100.0, -39.99), (33.33, -40.0), (12.0, 60.0), (-100.0, -40.0), (100.0, 60.0)]
    beside = [(-100.01, 0.0), (100.01, 0.0), (0.0, -40.01), (0.0, 60.01)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(edges + beside)], "feature_id long, lng double, lat double")
    x, y = mercator(F.col("lng"), F.col("lat"))
    # stored places that rounding moved by a few units in the last place
    for k in (-2, 0, 2):
        stored = rows.select("feature_id", (x * (1 + k * 2.3e-16)).alias("x"), (y * (1 + k * 2.3e-16)).alias("y"))
        found = requests.native_window(stored, (-100.0, -40.0, 100.0, 60.0), 3857)
        assert sorted(r.feature_id for r in found.collect()) == list(range(len(edges)))


@pytest.mark.parametrize("predicate", ["intersects", "within", "contains"])
def test_boxes_are_joined_by_their_sides(spark, predicate):
    r = random.Random(predicate)
    ring = lambda *c: [{"x": float(x), "y": float(y)} for x, y in (*c, c[0])]

    def shape(i):
        x, y, w, h = r.randrange(12), r.randrange(12), r.randrange(1, 6), r.randrange(1, 6)
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        if i % 3 == 0:
            return ring(*corners[:3])
        return ring(*(corners if i % 2 else corners[::-1]))

    boxes = spark.createDataFrame([(i, shape(i)) for i in range(90)], f"feature_id long, ring array<{shapes.POINT}>")
    a, b = (boxes.select(F.col("feature_id").alias(n), F.col("ring").alias(f"{n}_r")) for n in "ab")
    every = a.join(b, F.col("a") != F.col("b")).filter(geometry.PREDICATES[predicate](F.col("a_r"), F.col("b_r")))
    want = sorted((x.a, x.b) for x in every.select("a", "b").collect())
    assert want and sorted(tuple(x) for x in geometry.spatial_join(boxes, boxes, predicate, 4.0).collect()) == want
    plan = geometry.spatial_join(boxes.filter("feature_id % 3 <> 0"), boxes.filter("feature_id % 3 <> 0"), predicate, 4.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "a_ring" not in plan.split("Join")[0]  # no ring is looked at for a pair


def test_loose_rings_are_read_once(spark):
    rows = spark.createDataFrame([], f"loose array<array<{shapes.POINT}>>")
    plan = rows.select(shapes.assemble(F.col("loose")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("loose#") == 1


def test_vectors_of_a_small_file_are_dealt_to_tasks(spark):
    assert core.QUERIES["text_embeddings"](spark, SMALL).rdd.getNumPartitions() > 1
    rows = spark.createDataFrame([("Ä1",), (None,)], "t string")
    one, none = (x.v for x in rows.select(columns.text_embedding(F.col("t")).alias("v")).collect())
    assert one[33] == hashlib.sha256("Ä133".encode()).digest()[1] / 255 and none == [None] * 256


def test_a_tour_works_out_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def cost(c):
        seen.add(1)
        return c

    rows = spark.createDataFrame([(i, (i + 1) % 5, 1.0 + i) for i in range(5)], "from_id long, to_id long, c double")
    edges = rows.select("from_id", "to_id", cost("c").alias("cost"))
    assert [s for s, _ in network.tour(edges, [0, 2, 4])] == [0, 2, 4, 0]
    assert seen.value <= 10  # a checkpoint reads what it keeps twice
