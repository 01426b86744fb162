"""Operators that must hand on no list of all pairs."""

import math

import pytest

from chronoterra.operators import linear, nearest, overlays, similarity, vector_tiles


@pytest.mark.parametrize("pack", [3, 2048])
def test_places_on_routes_meet_in_packs(spark, monkeypatch, pack):
    monkeypatch.setattr(linear, "PACK", pack)
    spots = [(i * 37 % 11 / 1.0, i * 23 % 7 / 1.0) for i in range(20)] + [(5.0, 5.0), (5.0, 5.0)]
    vertices = spark.createDataFrame([(k, i, x, y + k) for k in (0, 1) for i, (x, y) in enumerate(spots)] + [(2, 0, 1.0, 1.0)], "route int, seq int, lng double, lat double")
    asked = [(k, 10 * i, i * 1.7 % 11, i * 2.3 % 9) for k in (0, 1, 2, 3) for i in range(12)] + [(0, 999, 5.0, 5.0), (1, 998, None, 2.0), (1, 997, 2.0, None)]
    out = linear.locate_points(vertices, spark.createDataFrame(asked, "route int, point long, lng double, lat double"))
    measured = {}
    for r in linear.measured(vertices).orderBy("route", "seq").collect():
        measured.setdefault(r.route, []).append(r)
    want = {}
    for route, point, px, py in asked:
        for a, b in zip(measured.get(route, []), measured.get(route, [])[1:]):
            dx, dy = b.lng - a.lng, b.lat - a.lat
            size = dx * dx + dy * dy
            if px is None or py is None:
                off, t = 0.0, 1.0 if size > 0 else 0.0
            else:
                t = max(0.0, min(1.0, ((px - a.lng) * dx + (py - a.lat) * dy) / size)) if size > 0 else 0.0
                off = (a.lng + t * dx - px) ** 2 + (a.lat + t * dy - py) ** 2
            want[route, point] = min(want.get((route, point), (math.inf, 0)), (off, a.measure + t * (b.measure - a.measure)))
    got = {(r.route, r.point): r.measure for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k][1], rel_tol=1e-9, abs_tol=1e-6) for k in got)
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # of a point and a pack one row is left


def test_duplicates_are_multiplied_in_tasks(spark):
    rows = [(i, [math.sin(i * j + j) for j in range(1, 9)]) for i in range(120)] + [(200, [1.0, 2.0]), (201, [2.0, 4.1]), (202, [0.0] * 8), (203, None), (204, [1.0, None])]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    out = similarity.duplicates(vectors, vectors.filter("id % 10 = 0"), 0.6, block=7)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    good = {i: v for i, v in rows if v and None not in v and any(v)}
    want = {(min(i, j), max(i, j)): s for i in good for j in good if i != j and j % 10 == 0 and len(good[i]) == len(good[j]) and (s := cosine(good[i], good[j])) > 0.6}
    got = {(r.a, r.b): r.score for r in out.collect()}
    assert got.keys() == want.keys() and (200, 201) in got
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got)
    assert "Generate" not in out._jdf.queryExecution().toString()  # no row for each vector and asked one


def test_pairs_are_overlaid_by_cell_whatever_the_files(spark):
    box = lambda x, y: [[[(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0), (x, y)]]]
    rows = lambda n: spark.createDataFrame([(i, box(i * 3.0 % 40, i * 7.0 % 20)) for i in range(n)], f"feature_id long, shape {overlays.kernel.SHAPE_TYPE}").coalesce(1)
    out = overlays.overlay_pairs(rows(20), rows(30), 4.0)
    want = {(a, b) for a in range(20) for b in range(30) if abs(a * 3.0 % 40 - b * 3.0 % 40) < 2 and abs(a * 7.0 % 20 - b * 7.0 % 20) < 2}
    assert {(r.a, r.b) for r in out.select("a", "b").collect()} == want
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()  # before the pairs are there


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_neighbours_are_found_in_packs(spark, monkeypatch, leaf):
    for name, value in (("LEAF", leaf), ("PACK", 3), ("DEPTH", 3)):
        monkeypatch.setattr(nearest, name, value, raising=False)
    sites = [(i, i * 37 % 41 / 2.0, i * 23 % 29 / 2.0) for i in range(40)] + [(100 + i, 7.0 + i % 4 / 64, 7.0 + i // 4 / 64) for i in range(20)]  # leaves of over LEAF points
    asked = [(i, i * 1.7 % 21, i * 2.3 % 15) for i in range(25)] + [(50 + i, 7.0 + i / 128, 7.0) for i in range(8)] + [(90, None, 1.0)]
    rows = [spark.createDataFrame(r, "feature_id long, lng double, lat double") for r in (asked, sites)]
    out = nearest.knn_join(*rows, 5)
    want = {(a, i): (b, d) for a, x, y in asked if x is not None for i, (d, b) in enumerate(sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), b) for b, u, v in sites)[:5], 1)}
    assert {(r.a, r["rank"]): (r.b, r.d) for r in out.collect()} == want
    assert "windowspecdefinition(a#" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each asking point and point of a leaf is sorted


def test_features_are_dealt_before_they_are_cut(spark, monkeypatch):
    box = lambda x, y, w: [[[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]]
    shapes = [(i, i * 37.0 % 300 - 169.7, i * 13.0 % 100 - 59.7, 1.0 + i % 4) for i in range(60)]
    rows = spark.createDataFrame([(i, vector_tiles.POLYGON, box(x, y, w), {"k": str(i)}) for i, x, y, w in shapes], f"feature_id long, kind int, shape {overlays.SHAPE}, attributes map<string,string>").coalesce(1)
    spread = vector_tiles._on_tiles(rows, 4, 4096, 64)
    assert "REPARTITION_BY_COL" in spread._jdf.queryExecution().executedPlan().toString()
    tiles = {(r.feature_id, r.tx, r.ty): r.inside for r in spread.select("feature_id", "tx", "ty", "inside").collect()}
    count = {i: sum(k[0] == i for k in tiles) for i, *_ in shapes}
    assert all(inside == (count[i] == 1) for (i, _, _), inside in tiles.items()) and set(tiles.values()) == {True, False}
    monkeypatch.setattr(vector_tiles, "ROWS", 2)  # of a crowded tile few decoded features are held at once
    got = {(r.feature_id, r.tx, r.ty): r.tags["k"] for r in vector_tiles.decoded(vector_tiles.shape_tiles(rows, 4)).collect()}
    assert got == {k: str(k[0]) for k in tiles}
