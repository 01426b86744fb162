"""Encoded tiles of shapes against a plain rendering of what they should hold."""

import math
import random

import pytest

from chronoterra.operators import vector_tiles as vt
from chronoterra.operators.overlays import SHAPE

ROWS = f"feature_id long, kind int, shape {SHAPE}, attributes map<string,string>"


def lng(x, zoom):
    """Longitude and latitude of places in tiles."""
    return x / (1 << zoom) * 360 - 180


def lat(y, zoom):
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / (1 << zoom)))))


def shape(parts, zoom):
    return [[[{"x": lng(x, zoom), "y": lat(y, zoom)} for x, y in path] for path in part] for part in parts]


def tiles(spark, rows, zoom):
    made = vt.shape_tiles(spark.createDataFrame([(i, k, shape(s, zoom) if s is not None else None, a) for i, k, s, a in rows], ROWS), zoom)
    out = {}
    for r in made.collect():
        (layer,) = vt.decode_tile(bytes(r.mvt))
        assert (layer["name"], layer["units"]) == ("features", 4096) and len(layer["features"]) == r.n
        out[r.tx, r.ty] = {f["id"]: f for f in layer["features"]}
    return out


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def area(paths):
    return sum(p[0] * q[1] - q[0] * p[1] for path in paths for p, q in zip(path, path[1:], strict=False)) / 2


def test_polygons_are_cut_with_a_buffer(spark):
    got = tiles(spark, [(1, vt.POLYGON, [[box(4.5, 4.5, 5.5, 5.25)]], {}), (2, vt.POLYGON, [[box(4.25, 4.25, 4.75, 4.75), box(4.4, 4.4, 4.6, 4.6)]], {}), (3, vt.POLYGON, [[box(4.001, 3.5, 4.5, 3.999)]], {})], 4)
    assert set(got) == {(4, 4), (5, 4), (4, 5), (5, 5), (4, 3)}
    assert set(map(frozenset, got[4, 4][1]["paths"])) == {frozenset(box(2048, 2048, 4160, 4160))}  # 64 units beyond the tile
    assert set(got[5, 5][1]["paths"][0]) == set(box(-64, -64, 2048, 1024))
    assert area(got[4, 4][2]["paths"]) == pytest.approx(2048**2 - 819**2, rel=1e-3)
    outer, hole = got[4, 4][2]["paths"]
    assert area([outer]) > 0 > area([hole])
    assert 3 not in got[4, 4]  # in the buffer alone, so not on this tile


def test_concave_parts_and_lines(spark):
    cup = [(4.1, 3.5), (4.9, 3.5), (4.9, 4.5), (4.7, 4.5), (4.7, 3.8), (4.3, 3.8), (4.3, 4.5), (4.1, 4.5), (4.1, 3.5)]
    got = tiles(spark, [(1, vt.POLYGON, [[cup]], {}), (2, vt.LINE, [[[(3.5, 4.5), (4.5, 4.5), (4.5, 3.5)]], [[(4.1, 4.1), (4.2, 4.1), (4.2, 4.1)]]], {})], 4)
    assert len(got[4, 4][1]["paths"]) == 2 and len(got[4, 3][1]["paths"]) == 1
    assert sorted(got[4, 4][2]["paths"]) == sorted([[(-64, 2048), (2048, 2048), (2048, -64)], [(410, 410), (819, 410)]])
    assert got[3, 4][2]["paths"] == [[(2048, 2048), (4160, 2048)]]
    assert set(got) == {(4, 3), (4, 4), (3, 4)}


def test_points_and_attributes(spark):
    tags = {"name": '"Zoë"', "n": "7", "less": "-3", "share": "0.25", "yes": "true", "no": "false", "none": "null", "list": "[1,2]", "big": "18446744073709551616"}
    got = tiles(spark, [(1, vt.POINT, [[[(4.5, 4.25)]], [[(4.75, 4.5)]], [[(5.5, 4.5)]]], tags), (2, vt.POINT, [[[(4.0625, 4.03125)]]], {"name": '"Zoë"', "n": '"7"'}), (3, vt.POINT, [[[(4.1, 4.1)]]], None), (4, vt.POINT, None, tags), (5, vt.POINT, [], tags)], 4)
    assert got[4, 4][1]["paths"] == [[(2048, 1024)], [(3072, 2048)]]
    assert got[4, 4][1]["tags"] == {"name": "Zoë", "n": 7, "less": -3, "share": 0.25, "yes": True, "no": False, "list": "[1,2]", "big": 2.0**64}
    assert got[4, 4][2]["tags"] == {"name": "Zoë", "n": "7"} and got[4, 4][3]["tags"] == {}
    assert set(got) == {(4, 4), (5, 4)} and set(got[4, 4]) == {1, 2, 3}


def test_a_crowded_tile_and_repeated_features(spark):
    r = random.Random(2)
    rows = [(i % 400, vt.POINT, [[[(4 + r.random(), 4 + r.random())]]], {"id": str(i), "kind": f'"{i % 3}"'}) for i in range(800)]
    made = vt.shape_tiles(spark.createDataFrame([(i, k, shape(s, 4), a) for i, k, s, a in rows], ROWS).repartition(5), 4)
    (tile,) = made.collect()
    (layer,) = vt.decode_tile(bytes(tile.mvt))
    assert tile.n == len(layer["features"]) == 800
    assert sorted(f["tags"]["id"] for f in layer["features"]) == list(range(800))  # every branch's feature has its own tags
    assert all(f["tags"]["kind"] == str(f["tags"]["id"] % 3) and f["id"] == f["tags"]["id"] % 400 for f in layer["features"])
    raw = vt._fields(vt._fields(bytes(tile.mvt))[3][0])
    assert len(raw[3]) == len(set(raw[3])) == 2 and len(raw[4]) == len(set(raw[4])) == 803


def test_no_rows_no_tiles(spark):
    assert vt.shape_tiles(spark.createDataFrame([], ROWS), 4).collect() == []
