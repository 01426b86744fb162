"""Nearest-neighbour joins and Voronoi cells against brute force."""

import math
import random

import pytest

from chronoterra import shape_queries
from chronoterra.operators import nearest


def points(spark, rows):
    return spark.createDataFrame(rows, "feature_id long, lng double, lat double")


def brute(left, right, k, other=False):
    out = []
    for a, x, y in left:
        if x is None or y is None:
            continue
        d = sorted((math.sqrt((x - bx) * (x - bx) + (y - by) * (y - by)), b) for b, bx, by in right if bx is not None and by is not None and not (other and a == b))
        out += [(a, i, b, round(far, 9)) for i, (far, b) in enumerate(d[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.a, r["rank"], r.b, round(r.d, 9)) for r in df.collect())


@pytest.mark.parametrize(("leaf", "k"), [(4, 3), (16, 5), (10_000, 5)])
def test_knn_equals_brute_force(spark, monkeypatch, leaf, k):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    r = random.Random(leaf)
    right = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(60)]
    right += [(100 + i, 10 + r.random() * 1e-4, 20 + r.random() * 1e-4) for i in range(80)]  # a crowded place
    right += [(300 + i, 5.0, 5.0) for i in range(30)]  # copies of one position
    right += [(400, None, 1.0), (401, 3.0, None)]
    left = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(40)] + [(50, 10.00005, 20.0), (51, 5.0, 5.0), (52, None, None), (53, 500.0, 500.0)]
    assert got(nearest.knn_join(points(spark, left), points(spark, right), k)) == brute(left, right, k)


def test_other_fewer_and_none(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, None, 2.0)]
    d = points(spark, rows)
    assert got(nearest.knn_join(d, d, 9, other=True)) == brute(rows, rows, 9, other=True)
    assert nearest.knn_join(d, d.filter("false"), 2).collect() == []
    assert nearest.knn_join(d.filter("false"), d, 2).collect() == []


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 4)
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(8) for y in range(8))]
    left = [(0, 3.5, 3.5), (1, 3.0, 3.0), (2, -1.0, 3.5)]
    assert got(nearest.knn_join(points(spark, left), points(spark, right), 6)) == brute(left, right, 6)


def area(ring):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:], strict=False)) / 2


def inside(ring, x, y):
    return all((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) >= -1e-9 for a, b in zip(ring, ring[1:], strict=False))


@pytest.mark.parametrize("start", [1, 6])
def test_voronoi_cells_tile_the_envelope(spark, start):
    r = random.Random(start)
    sites = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(40)] + [(90 + i, 2 + r.random() / 50, 3 + r.random() / 50) for i in range(20)]
    sites += [(200, sites[0][1], sites[0][2]), (201, 30.0, 5.0), (202, None, 1.0)]
    cells = {c.feature_id: c.ring for c in nearest.voronoi(points(spark, sites), (0.0, 0.0, 10.0, 10.0), start=start).collect()}
    assert sum(map(area, cells.values())) == pytest.approx(100, abs=1e-6)
    assert 200 not in cells and 202 not in cells  # a copy shares the smaller id's cell
    known = [(i, x, y) for i, x, y in sites if x is not None and i != 200]
    for _ in range(2000):
        x, y = r.uniform(0, 10), r.uniform(0, 10)
        owner = min(known, key=lambda s: (s[1] - x) ** 2 + (s[2] - y) ** 2)[0]
        assert inside(cells[owner], x, y)


def test_voronoi_of_one_site_and_of_a_grid(spark):
    box = (0.0, 0.0, 4.0, 4.0)
    (one,) = nearest.voronoi(points(spark, [(7, 1.0, 1.0)]), box).collect()
    assert one.feature_id == 7 and area(one.ring) == 16
    grid = points(spark, [(4 * i + j, i + 0.5, j + 0.5) for i in range(4) for j in range(4)])
    assert {round(area(c.ring), 9) for c in nearest.voronoi(grid, box).collect()} == {1.0}
    assert nearest.voronoi(grid.filter("false"), box).collect() == []


def test_members_on_shared_sides(spark):
    sites = [(3, 1.0, 1.0), (1, 3.0, 1.0), (2, 1.0, 3.0), (0, 3.0, 3.0), (9, 1.0, 1.0)]
    asked = [(i, i % 9 / 2, i // 9 / 2) for i in range(81)]  # a quarter of them between two sites or four
    cells = nearest.voronoi(points(spark, sites), (0.0, 0.0, 4.0, 4.0))
    got = {r.a: r.b for r in nearest.cell_members(points(spark, asked), points(spark, sites), cells).collect()}
    assert got == {a: min(((sx - x) ** 2 + (sy - y) ** 2, s) for s, sx, sy in sites)[1] for a, x, y in asked}


def test_cells_that_reach_beyond_their_surroundings(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 8)
    monkeypatch.setattr(nearest, "HALO", 20, raising=False)  # some leaves have more around them
    r = random.Random(5)
    sites = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(25)] + [(50 + i, 7 + r.random(), 7 + r.random()) for i in range(15)]
    sites += [(100 + i, 1.0, i / 4) for i in range(9)] + [(200, 40.0, 5.0), (201, 5.0, -25.0), (202, sites[0][1], sites[0][2])]
    rows = points(spark, sites).repartition(3)
    cells = nearest.voronoi(rows, (0.0, 0.0, 10.0, 10.0), start=3)
    rings = {c.feature_id: c.ring for c in cells.collect()}
    assert len(rings) == cells.count() and 202 not in rings and sum(map(area, rings.values())) == pytest.approx(100, abs=1e-6)
    asked = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(300)]
    want = {a: min(((sx - x) ** 2 + (sy - y) ** 2, s) for s, sx, sy in sites)[1] for a, x, y in asked}
    assert all(inside(rings[want[a]], x, y) for a, x, y in asked)
    assert {m.a: m.b for m in nearest.cell_members(points(spark, asked), rows, cells).collect()} == want


def test_most_cells_are_not_asked_about_and_no_table_goes_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 16)
    r, asks, join = random.Random(3), [], nearest.knn_join
    monkeypatch.setattr(nearest, "knn_join", lambda left, *rest, **named: asks.append(left.count()) or join(left, *rest, **named))
    sites = points(spark, [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(400)])
    cells = nearest.voronoi(sites, (0.0, 0.0, 10.0, 10.0))
    assert cells.count() == 400 and sum(asks) < 200  # of about 2400 corners
    plan = shape_queries.voronoi_members(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
