"""Overlay of shapes of any form against probes, and unions against counted cells."""

import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoterra.functions import overlay as kernel
from chronoterra.functions import shapes
from chronoterra.operators import overlays


def packed(polygons):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in polygon] for polygon in polygons]


def plain(shape):
    return [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in shape]


def inside(polygons, x, y):
    odd = False
    for polygon in polygons:
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
    return odd


def turned(ring):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def overlay(a, b, operation):
    out, meets = kernel.overlay(pa.array([packed(a)], kernel.SHAPE), pa.array([packed(b)], kernel.SHAPE), operation)
    return plain(out.to_pylist()[0]), bool(meets[0])


CUP = [[[(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)]]]
RING = [[square(0, 0, 4, 4), square(1, 1, 3, 3)]]


@pytest.mark.parametrize(
    ("a", "b", "operation", "sizes", "area"),
    [
        (CUP, [[square(-1, 2, 4, 4)]], "intersection", [1, 1], 2),  # a box above the notch leaves two parts
        (CUP, [[square(-1, 2, 4, 4)]], "difference", [1], 5),
        (CUP, [[square(-1, 2, 4, 4)]], "union", [2], 15),  # the notch becomes a hole
        (RING, [[square(1, 1, 3, 3)]], "union", [1], 16),  # a hole filled exactly
        (RING, [[square(2, 2, 5, 5)]], "intersection", [1], 3),
        (RING, [[square(2, 2, 5, 5)]], "difference", [1], 9),
        ([[square(0, 0, 4, 4)]], [[square(1, 1, 2, 2)]], "difference", [2], 15),
        ([[square(0, 0, 1, 1)]], [[square(1, 0, 2, 1)]], "union", [1], 2),  # a shared side goes
        ([[square(0, 0, 1, 1)]], [[square(1, 1, 2, 2)]], "union", [1, 1], 2),  # a shared corner doesn't join
        ([[square(0, 0, 1, 1)]], [[square(1, 0, 2, 1)]], "intersection", [], 0),
        ([[square(0, 0, 2, 2)]], [[square(0, 0, 2, 2)]], "symmetric_difference", [], 0),
        ([[square(0, 0, 2, 2)], [square(3, 0, 5, 2)]], [[square(1, 0, 4, 1)]], "difference", [1, 1], 6),
    ],
)
def test_known_overlays(a, b, operation, sizes, area):
    got, meets = overlay(a, b, operation)
    assert [len(p) for p in got] == sizes and meets
    assert sum(turned(r) for p in got for r in p) / 2 == pytest.approx(area)


def test_shapes_apart_do_not_meet():
    assert overlay([[square(0, 0, 1, 1)]], [[square(2, 0, 3, 1)]], "intersection") == ([], False)
    assert overlay(RING, [[square(1.5, 1.5, 2.5, 2.5)]], "intersection") == ([], False)  # inside the hole
    ((ring,),), _ = overlay([], [[square(2, 0, 3, 1)]], "union")
    assert set(ring) == set(square(2, 0, 3, 1)) and turned(ring) == 2


corner = st.tuples(st.integers(0, 9), st.integers(0, 9))
crooked = st.lists(corner, min_size=3, max_size=9).map(lambda c: [[[*c, c[0]]]])
TRUTH = {"intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "union": lambda a, b: a or b, "symmetric_difference": lambda a, b: a != b}


@settings(max_examples=300, deadline=None)
@given(crooked, crooked, st.sampled_from(sorted(TRUTH)), st.integers(0, 10**6))
def test_overlays_of_crooked_rings_say_what_probes_say(a, b, operation, seed):
    got, _ = overlay(a, b, operation)
    r = random.Random(seed)
    for _ in range(30):
        x, y = r.random() * 10 - 0.5, r.random() * 10 - 0.5
        assert inside(got, x, y) == TRUTH[operation](inside(a, x, y), inside(b, x, y))
    for polygon in got:
        for i, ring in enumerate(polygon):
            assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1  # simple
            assert (turned(ring) > 0) == (i == 0)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_curved_shapes_in_one_batch(seed):
    import math

    r = random.Random(seed)

    def blob():
        far = [2 + r.random() for _ in range(20)]
        return [[[(math.cos(t / 20 * math.tau) * far[t] + cx, math.sin(t / 20 * math.tau) * far[t] + cy) for t in range(20)]]]

    rows = []
    for _ in range(6):
        cx, cy = r.random() * 2, r.random() * 2
        a = blob()
        cx, cy = r.random() * 4, r.random() * 4
        rows.append((a, blob()))
    a, b = (pa.array([packed(x[i]) for x in rows], kernel.SHAPE) for i in (0, 1))
    out = {op: [plain(x) for x in kernel.overlay(a, b, op)[0].to_pylist()] for op in TRUTH}
    size = lambda polygons: sum(turned([*ring, ring[0]]) for p in polygons for ring in p) / 2
    for i, (p, q) in enumerate(rows):
        one, two, both = size(p), size(q), size(out["intersection"][i])
        assert size(out["union"][i]) == pytest.approx(one + two - both, abs=1e-6)
        assert size(out["difference"][i]) == pytest.approx(one - both, abs=1e-6)


def test_exact_orientation():
    big = 2**38
    cases = [(big - 1, big - 3, big - 2, big - 4), (big, big - 1, big + 1, big), (-big, 3, big, -3), (5, 0, 7, 0), (0, 0, 1, 1)]
    for case in cases:
        ax, ay, bx, by = (kernel.np.array([v]) for v in case)
        want = case[0] * case[3] - case[1] * case[2]
        assert int(kernel.cross_sign(ax, ay, bx, by)[0]) == (want > 0) - (want < 0)


def frame(spark, rows, columns="feature_id long, shape"):
    return spark.createDataFrame([(*k, packed(s) if s is not None else None) for *k, s in rows], f"{columns} {overlays.SHAPE}")


def test_masks_keep_columns_and_odd_rows(spark):
    rows = frame(spark, [(1, "a", CUP), (2, "b", None), (3, "c", []), (4, "d", [[square(50, 50, 51, 51)]]), (5, "e", [[square(0, 2, 1, 3)]])], "feature_id long, `x.y` string, shape")
    mask = F.lit(None).cast(overlays.SHAPE)
    assert overlays.clip(rows, mask).count() == 0
    box = overlays.as_shape(F.array(*[shapes.point(x, y) for x, y in square(-1, 2, 4, 4)]))
    got = {r.feature_id: (r["x.y"], r.shape) for r in overlays.intersect(rows, box).collect()}
    assert set(got) == {1, 5} and got[1][0] == "a" and len(got[1][1]) == 2
    assert {r.feature_id for r in overlays.difference(rows, box).collect()} == {1}  # 5 is covered, 4 disjoint
    assert overlays.clip(rows.filter("false"), box).collect() == []


def test_repair_splits_a_bow_tie(spark):
    rows = frame(spark, [(1, [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]]), (2, [[[(0, 0), (1, 0)]]]), (3, [[square(0, 0, 1, 1)[::-1]]])])
    got = {r.feature_id: r.shape for r in overlays.repaired(rows).collect()}
    assert len(got[1]) == 2 and got[2] == []
    assert turned([(p.x, p.y) for p in got[3][0][0]]) == 2  # turned the right way


def test_geojson_shapes(spark):
    text = ['{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}', '{"type":"Point","coordinates":[1,2]}', None, "no json"]
    d = spark.createDataFrame(list(enumerate(text)), "i long, t string").select("i", overlays.shape_of_geojson(F.col("t")).alias("shape"))
    got = {r.i: r.shape for r in d.collect()}
    assert len(got[0]) == 1 and len(got[1]) == 2 and got[2] is got[3] is None and not got[4]


def test_pairs_are_overlaid_once(spark):
    left = frame(spark, [(1, CUP), (2, [[square(10, 0, 14, 9)]])])
    right = frame(spark, [(7, [[square(-1, 2, 12, 4)]]), (8, [[square(1.2, 1.5, 1.8, 2)]])])
    got = {(r.a, r.b): sum(turned([(p.x, p.y) for p in ring]) for polygon in r.shape for ring in polygon) / 2 for r in overlays.overlay_pairs(left, right, 1.0).collect()}
    assert got == {(1, 7): 2.0, (2, 7): 4.0}


@pytest.mark.parametrize("cell", [1.0, 3.0, 100.0])
def test_outlines_cover_what_the_features_cover(spark, cell):
    r = random.Random(int(cell))
    rows, cells = [], {}
    for i in range(80):
        key = r.choice(["a", "b", None])
        x, y, w, h = r.randrange(-9, 9), r.randrange(-9, 9), r.randrange(1, 5), r.randrange(1, 5)
        rows.append((key, [[square(x, y, x + w, y + h)]]))
        cells.setdefault(key, set()).update((a, b) for a in range(x, x + w) for b in range(y, y + h))
    rows.append(("ring", RING))
    rows.append(("none", None))
    cells["ring"] = {(a, b) for a in range(4) for b in range(4)} - {(1, 1), (1, 2), (2, 1), (2, 2)}
    out = overlays.outlines(frame(spark, rows, "key string, shape"), cell).collect()
    for key, own in cells.items():
        polygons = [[[(p.x, p.y) for p in ring] for ring in o.polygon] for o in out if o.key == key]
        assert {(x, y) for x in range(-12, 16) for y in range(-12, 16) if inside(polygons, x + 0.5, y + 0.5)} == own
        assert sum(turned(ring) for p in polygons for ring in p) / 2 == len(own)
        border = sum((a + dx, b + dy) not in own for a, b in own for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert sum(abs(p[0] - q[0]) + abs(p[1] - q[1]) for poly in polygons for ring in poly for p, q in zip(ring, ring[1:], strict=False)) == border
        assert all(turned(ring) > 0 if i == 0 else turned(ring) < 0 for p in polygons for i, ring in enumerate(p))
    assert {o.key for o in out} == set(cells)


def test_outlines_of_slanted_shapes(spark):
    r = random.Random(5)
    rows = []
    for _ in range(25):
        x, y, s = r.random() * 10, r.random() * 10, 1 + r.random() * 2
        rows.append(("k", [[[(x, y), (x + s, y + s / 3), (x + s / 2, y + s), (x, y)]]]))
    d = frame(spark, rows, "key string, shape")
    polygons = [[[(p.x, p.y) for p in ring] for ring in o.polygon] for o in overlays.outlines(d, 2.0).collect()]
    every = [s for _, s in rows]
    for _ in range(3000):
        x, y = r.random() * 13, r.random() * 13
        assert inside(polygons, x, y) == any(inside(s, x, y) for s in every)
    planar = overlays.covered_area(d, 2.0).first().planar
    assert planar == pytest.approx(sum(turned(ring) for p in polygons for ring in p) / 2, abs=1e-5)


def test_a_crowded_cell_and_an_empty_table(spark):
    box = [[square(0.25, 0.25, 0.75, 0.75)]]
    many = frame(spark, [("k", box)] * 500 + [("k", [[square(0.5, 0.5, 0.9, 0.9)]])] * 300, "key string, shape")
    got = overlays.covered_area(many, 1.0).first()
    assert got.planar == pytest.approx(0.25 + 0.16 - 0.0625)
    assert overlays.outlines(many.filter("false"), 1.0).collect() == []


def test_unions_of_many_batches(spark):
    """A group goes on from batch to batch, and Spark's batches name array elements otherwise than the kernel's."""
    rows = [("k", i, packed([[square(i % 20 * 0.5, i % 7, i % 20 * 0.5 + 1, i % 7 + 1)]])) for i in range(300)]
    d = spark.createDataFrame(rows, f"key string, n int, shape {kernel.SHAPE_TYPE}").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        (r,) = overlays.covered_area(d, 4.0).collect()
        out = overlays.outlines(d, 4.0).select(F.sum(overlays.planar_area(F.array("polygon")))).first()[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert r.planar == pytest.approx(10.5 * 7) and out == pytest.approx(10.5 * 7)


@pytest.mark.parametrize(("pack", "crowd"), [(512, 4096), (2, 3)])
def test_shared_areas_are_those_of_the_overlaid_pairs(spark, monkeypatch, pack, crowd):
    monkeypatch.setattr(overlays, "PACK", pack)
    monkeypatch.setattr(overlays, "CROWD", crowd)
    monkeypatch.setattr(overlays.kernel, "PAIRS", 40 * pack)  # a pair's edges are summed up in several parts
    r = random.Random(pack)
    star = lambda x, y: [[[(x + d * math.cos(t), y + d * math.sin(t)) for t, d in ((k * math.pi / 5, r.uniform(0.3, 2)) for k in range(10))]]]
    closed = lambda shape: [[[*ring, ring[0]] for ring in polygon] for polygon in shape]
    some = lambda n: [(i, closed(star(r.uniform(-4, 4), r.uniform(-4, 4)))) for i in range(n)]
    tie, turned_round = [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]], [[square(-3, -3, 3, 3)[::-1]]]
    left, right = some(15) + [(50, RING), (51, tie), (52, None), (53, CUP)], some(20) + [(70, turned_round), (71, CUP), (72, [[square(2, 0, 3, 1)]]), (73, [[square(0, 1, 1, 2)], [square(5, 5, 6, 6)]])]
    left, right = (frame(spark, d).repartition(3) for d in (left, right))
    want = {(x.a, x.b): x.area for x in overlays.overlay_pairs(left, right, 1.5).select("a", "b", overlays.planar_area(F.col("shape")).alias("area")).collect()}
    rows = overlays.overlay_areas(left, right, 1.5)
    got = {(x.a, x.b): x.area for x in rows.collect()}
    assert rows.count() == len(got) > 50 and got.keys() == {k for k, v in want.items() if v >= overlays.LEAST_AREA}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in got)
    assert (51, 72) not in got and got[51, 70] == 2.0


def test_overlaid_pairs_overlays_no_single_pair(spark):
    from chronoterra import shape_queries

    plan = shape_queries.overlaid_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "a_shape" not in plan and "b_edges" in plan and plan.count("strategy=merge") >= 1
