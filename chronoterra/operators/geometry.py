"""Shapes of features: windows, clipping, hulls, simplification, WKB, and joins by predicate.

Per-shape work is Column expressions (functions/shapes) where those can say it; only a convex hull, a
Douglas-Peucker walk and binary formats are small Python helpers over Arrow batches.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from .spatial import circles

# ---- per shape, in Columns ---------------------------------------------------------------------


def clip(rows: DataFrame, window: Column) -> DataFrame:
    """(feature_id, ring): the part of each convex ring inside a convex window; features outside it are absent. For other shapes see overlays."""
    return rows.filter(shapes.intersects(F.col("ring"), window)).select("feature_id", shapes.clip(F.col("ring"), window).alias("ring")).filter("size(ring) > 0")


def intersect(rows: DataFrame, window: Column) -> DataFrame:
    """As clip, with the other columns."""
    return rows.filter(shapes.intersects(F.col("ring"), window)).withColumn("ring", shapes.clip(F.col("ring"), window)).filter("size(ring) > 0")


def difference(rows: DataFrame, window: Column) -> DataFrame:
    """Features that meet the window without their part in it, as ``rings``; covered and disjoint ones are absent."""
    met = rows.filter(shapes.intersects(F.col("ring"), window))
    return met.withColumn("rings", shapes.difference(F.col("ring"), window)).filter("size(rings) > 0").drop("ring")


def split_by_line(rows: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """(feature_id, part, ring): both parts of each ring that the line divides; the others are absent."""
    parts = rows.select("feature_id", shapes.split(F.col("ring"), shapes.point(*a), shapes.point(*b)).alias("parts")).filter("size(parts) > 1")
    return parts.select("feature_id", F.posexplode("parts").alias("part", "ring"))


def buffers(rows: DataFrame, metres: float) -> DataFrame:
    """(feature_id, ring, area): circles around points with their area on the sphere."""
    return circles(rows, metres).withColumn("area", shapes.sphere_area(F.col("ring")))


def shape_stats(rows: DataFrame) -> DataFrame:
    """(n, area, length, xmin, ymin, xmax, ymax, cx, cy) of rows with ``ring`` and ``path``, either may be null; sums are 0 without any."""
    box = shapes.bounds(F.coalesce("ring", "path"))
    centre = F.when(F.col("ring").isNotNull(), shapes.centroid(F.col("ring")))
    own = rows.select(F.when(F.col("ring").isNotNull(), shapes.sphere_area(F.col("ring"))).alias("area"), F.when(F.col("path").isNotNull(), shapes.length(F.col("path"))).alias("length"), box.alias("box"), centre.alias("c"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    return own.agg(F.count("*").alias("n"), total("area"), total("length"), F.min("box.xmin").alias("xmin"), F.min("box.ymin").alias("ymin"), F.max("box.xmax").alias("xmax"), F.max("box.ymax").alias("ymax"), F.avg("c.x").alias("cx"), F.avg("c.y").alias("cy"))


def quality(rows: DataFrame) -> DataFrame:
    """(total, null_geometry, invalid_geometry) of points: coordinates off the globe or not finite are invalid."""
    x, y = F.col("lng"), F.col("lat")
    null = x.isNull() | y.isNull()
    bad = ~null & (F.isnan(x) | F.isnan(y) | ~x.between(-180, 180) | ~y.between(-90, 90))
    return rows.agg(F.count("*").alias("total"), F.count_if(null).alias("null_geometry"), F.count_if(bad).alias("invalid_geometry"))


def repaired(rows: DataFrame) -> DataFrame:
    """(feature_id, ring): rings that break the rules, mended: repeated positions go, open rings are closed; a ring of under four positions has no shape and stays out."""
    ring = F.col("ring")
    once = F.filter(ring, lambda p, i: (i == 0) | ~p.eqNullSafe(F.element_at(ring, F.greatest(i, F.lit(1)))))
    closed = F.when(F.element_at(once, 1).eqNullSafe(F.element_at(once, -1)), once).otherwise(F.concat(once, F.slice(once, 1, 1)))
    told = rows.filter(F.size(ring) > 0).select("feature_id", "ring", closed.alias("mended"))
    return told.filter(~F.col("mended").eqNullSafe(ring) & (F.size("mended") >= 4)).select("feature_id", F.col("mended").alias("ring"))


PREDICATES = {"intersects": shapes.intersects, "within": shapes.within, "contains": lambda a, b: shapes.within(b, a), "touches": lambda a, b: shapes.edges_cross(a, b) & ~_overlap(a, b), "crosses": shapes.edges_cross}


def _overlap(a: Column, b: Column) -> Column:
    """Whether the insides meet: the part of ``a`` in ``b`` (convex) has an area."""
    return F.abs(shapes.twice_area(shapes.clip(a, shapes.wound(b, clockwise=False)))) > 1e-9


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, cell: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, and ``keep`` of the right side): pairs of different features whose rings meet the predicate.

    Both sides are dealt to the grid cells of side ``cell`` (degrees) that their boxes cover; a pair is
    judged once, in the cell of the lower left corner of what the boxes share. Two rings that are boxes
    themselves are judged by their sides; only pairs with another shape take their rings along.
    """
    rings = [d.select(F.col("feature_id").alias(n), F.col("ring").alias(f"{n}_ring"), *[shapes.bounds(F.col("ring"))[c].alias(f"{n}_{c}") for c in SIDES], *more) for d, n, more in ((left, "a", ()), (right, "b", keep))]
    a, b = ([d.filter(_is_box(n) == told) for told in (True, False)] for d, n in zip(rings, "ab", strict=True))
    out = []
    if predicate in BOX_PREDICATES:
        out.append(_met(a[0].drop("a_ring"), b[0].drop("b_ring"), cell).filter(BOX_PREDICATES[predicate]))
        rest = [(x, y) for x, y in ((a[1], rings[1]), (a[0], b[1])) if not (x if x is a[1] else y).isEmpty()]
    else:
        rest = [tuple(rings)]
    out += [_met(x, y, cell).filter(PREDICATES[predicate](F.col("a_ring"), F.col("b_ring"))) for x, y in rest]
    return reduce(DataFrame.union, [d.select("a", "b", *keep) for d in out])


SIDES = ("xmin", "ymin", "xmax", "ymax")
#: What a predicate says of two boxes, in their sides alone.
BOX_PREDICATES = {
    "intersects": "a_xmin <= b_xmax and b_xmin <= a_xmax and a_ymin <= b_ymax and b_ymin <= a_ymax",
    "within": "a_xmin > b_xmin and a_xmax < b_xmax and a_ymin > b_ymin and a_ymax < b_ymax",
    "contains": "b_xmin > a_xmin and b_xmax < a_xmax and b_ymin > a_ymin and b_ymax < a_ymax",
}


def _is_box(n: str) -> Column:
    """Whether the ring is that of its box: four upright and level sides with an area."""
    r = F.col(f"{n}_ring")
    x, y = ([r[i][c] for i in range(4)] for c in "xy")
    turns = lambda u, v: (u[0] == u[1]) & (v[1] == v[2]) & (u[2] == u[3]) & (v[3] == v[0])
    flat = (F.col(f"{n}_xmin") < F.col(f"{n}_xmax")) & (F.col(f"{n}_ymin") < F.col(f"{n}_ymax")) & (x[0] != x[2]) & (y[0] != y[2])
    return F.coalesce(F.when(F.size(r) == 5, (r[0] == r[4]) & flat & (turns(x, y) | turns(y, x))), F.lit(False))


def _met(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of different features whose boxes meet, each in one cell, by comparisons of plain numbers."""
    at = lambda v: F.floor(v / cell).cast("long")

    def dealt(d: DataFrame, n: str) -> DataFrame:
        i, j = (F.sequence(at(F.col(f"{n}_{c}min")), at(F.col(f"{n}_{c}max"))) for c in "xy")
        return d.filter(f"{n}_xmin is not null").withColumn("i", F.explode(i)).withColumn("j", F.explode(j))

    met = dealt(a, "a").join(dealt(b, "b"), ["i", "j"]).filter("a <> b").filter(BOX_PREDICATES["intersects"])
    corner = [at(F.greatest(F.col(f"a_{c}min"), F.col(f"b_{c}min"))) for c in "xy"]
    return met.filter((F.col("i") == corner[0]) & (F.col("j") == corner[1]))


def overlapping_pairs(rows: DataFrame, cell: float) -> DataFrame:
    """(a, b), a < b: unordered pairs of features whose rings overlap, each once."""
    return spatial_join(rows, rows, "intersects", cell).filter("a < b")


def union_area(rows: DataFrame, cell: float, by: str | None = None) -> DataFrame:
    """(key, n, area, planar): features, and the area that their rings cover together, in square metres on the sphere and square degrees; one row of zeros for no features and no key."""
    from .overlays import as_shape, covered_area

    own = rows.select((F.col(by) if by else F.lit(None).cast("string")).alias("key"), as_shape(F.col("ring")).alias("shape"))
    counts = own.groupBy("key").agg(F.count("*").alias("n")) if by else own.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("key"), "n")
    areas = covered_area(own, cell).withColumnRenamed("key", "of")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("area", "planar")]
    return counts.join(areas, counts["key"].eqNullSafe(areas["of"]), "left").select("key", "n", *zero)


def tiles_of(rows: DataFrame, zoom: int) -> DataFrame:
    """(feature_id, tx, ty): every tile that the box of a ring covers."""
    from .grids import tile_position

    box = shapes.bounds(F.col("ring"))
    (x0, y0), (x1, y1) = (tile_position(box[f"x{s}"], box[f"y{t}"], zoom) for s, t in (("min", "max"), ("max", "min")))
    last = F.lit((1 << zoom) - 1)
    at = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), last).cast("long")
    return rows.select("feature_id", F.explode(F.sequence(at(x0), at(x1))).alias("tx"), F.sequence(at(y0), at(y1)).alias("ys")).select("feature_id", "tx", F.explode("ys").alias("ty"))


# ---- hull and simplification ---------------------------------------------------------------------


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise, by sorted chains."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(side) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(reversed(ordered))


def convex_hull(rows: DataFrame) -> DataFrame:
    """(ring, area): the hull of all points (lng, lat); each task sends on the corners of its own hull only. No row without points."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[float, float]] = []
        for b in batches:
            kept = _hull(kept + list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in kept], pa.float64()), pa.array([p[1] for p in kept], pa.float64())], ["x", "y"])

    points = rows.filter("lng is not null and lat is not null").select(F.col("lng").cast("double"), F.col("lat").cast("double"))
    last = points.mapInArrow(corners, "x double, y double").repartition(1).mapInArrow(corners, "x double, y double")  # corners of hulls alone
    ring = last.agg(F.collect_list(F.struct("x", "y")).alias("ring")).filter("size(ring) > 0")
    return ring.select(F.concat("ring", F.slice("ring", 1, 1)).alias("ring")).withColumn("area", shapes.sphere_area(F.col("ring")))


def kept_places(path: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Places of the positions that Douglas-Peucker keeps, with a stack: those farther than ``tolerance`` from the chord."""
    keep, stack = {0, len(path) - 1}, [(0, len(path) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = path[a], path[b]
        dx, dy = bx - ax, by - ay
        size, far, at = dx * dx + dy * dy, -1.0, -1
        for i in range(a + 1, b):
            px, py = path[i][0] - ax, path[i][1] - ay
            t = min(1.0, max(0.0, (px * dx + py * dy) / size)) if size else 0.0
            d = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d > far:
                far, at = d, i
        if at >= 0 and far > tolerance * tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return sorted(keep)


def simplified_path(path: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    return [path[i] for i in kept_places(path, tolerance)]


_PATH = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def simplify(rows: DataFrame, tolerance: float, path: str = "path") -> DataFrame:
    """(feature_id, path, before, after): each path with fewer positions, and how many it had and has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = [[(p["x"], p["y"]) for p in x or ()] for x in b.column(1).to_pylist()]
            new = [simplified_path(p, tolerance) if len(p) > 2 else p for p in old]
            packed = pa.array([[{"x": x, "y": y} for x, y in p] for p in new], _PATH)
            yield pa.RecordBatch.from_arrays([b.column(0), packed, pa.array([len(p) for p in old], pa.int32()), pa.array([len(p) for p in new], pa.int32())], ["feature_id", "path", "before", "after"])

    kind = dict(rows.dtypes)["feature_id"]
    return rows.select("feature_id", F.col(path).cast(f"array<{shapes.POINT}>").alias("path")).mapInArrow(run, f"feature_id {kind}, path array<{shapes.POINT}>, before int, after int")


# ---- binary forms ----------------------------------------------------------------------------

#: The type codes of WKB.
WKB_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
_CODES = {v: k for k, v in WKB_TYPES.items()}
_PART = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


def encode_wkb(shape: dict) -> bytes:
    """Little-endian WKB of a GeoJSON geometry (x and y alone)."""
    kind, c = shape["type"], shape["coordinates"]
    head = struct.pack("<BI", 1, _CODES[kind])
    positions = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p[:2]) for p in ps)
    if kind == "Point":
        return head + struct.pack("<2d", *c[:2])
    if kind == "LineString":
        return head + positions(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(positions, c))
    return head + struct.pack("<I", len(c)) + b"".join(encode_wkb({"type": _PART[kind], "coordinates": p}) for p in c)


def decode_wkb(data: bytes) -> dict:
    """GeoJSON geometry of WKB or EWKB in either byte order; z and m are left out."""

    def read(at: int) -> tuple[dict, int]:
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 9 if code & 0x20000000 else 5
        more = bool(code & 0x80000000) + bool(code & 0x40000000)
        base = code & 0x0FFFFFFF
        more += (0, 1, 1, 2)[base // 1000]
        kind, width = WKB_TYPES[base % 1000], 8 * (2 + more)

        def count(at: int) -> int:
            return struct.unpack_from(order + "I", data, at)[0]

        def positions(at: int) -> tuple[list, int]:
            n = count(at)
            return [list(struct.unpack_from(order + "2d", data, at + 4 + width * i)) for i in range(n)], at + 4 + width * n

        if kind == "Point":
            return {"type": kind, "coordinates": list(struct.unpack_from(order + "2d", data, at))}, at + width
        if kind == "LineString":
            c, at = positions(at)
            return {"type": kind, "coordinates": c}, at
        n, parts = count(at), []
        at += 4
        for _ in range(n):
            if kind == "Polygon":
                part, at = positions(at)
            else:
                inner, at = read(at)
                part = inner["coordinates"]
            parts.append(part)
        return {"type": kind, "coordinates": parts}, at

    return read(0)[0]


def _map(rows: DataFrame, source: str, target: str, kind: str, arrow: pa.DataType, f) -> DataFrame:
    """Rows with one more column: ``f`` of every value of ``source``, null for null and for what ``f`` can't read."""
    at = rows.columns.index(source)

    def one(v):
        try:
            return None if v is None else f(v)
        except (KeyError, ValueError, TypeError, IndexError, struct.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(v) for v in b.column(at).to_pylist()], arrow)], [*b.schema.names, target])

    return rows.mapInArrow(run, rows.withColumn(target, F.lit(None).cast(kind)).schema)


def to_wkb(rows: DataFrame, geojson: str = "geojson", name: str = "wkb") -> DataFrame:
    return _map(rows, geojson, name, "binary", pa.binary(), lambda t: encode_wkb(json.loads(t)))


def from_wkb(rows: DataFrame, wkb: str = "wkb", name: str = "geojson") -> DataFrame:
    return _map(rows, wkb, name, "string", pa.string(), lambda d: json.dumps(decode_wkb(d), separators=(",", ":")))


def geojson_positions(geojson: Column) -> Column:
    """All positions of a GeoJSON geometry of any type, as struct (x, y), from its pairs of numbers."""
    number = r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?"
    pairs = F.regexp_extract_all(geojson, F.lit(rf"\[\s*({number}\s*,\s*{number})"), 1)
    split = lambda p: F.split(p, r"\s*,\s*")
    return F.transform(pairs, lambda p: F.struct(split(p)[0].cast("double").alias("x"), split(p)[1].cast("double").alias("y")))


def geojson_bounds(geojson: Column) -> Column:
    """(xmin, ymin, xmax, ymax) of a GeoJSON geometry; null without positions."""
    return F.when(F.size(geojson_positions(geojson)) > 0, shapes.bounds(geojson_positions(geojson)))
