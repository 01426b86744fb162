"""Planar shapes as Columns. A line is an array of structs (x, y) in degrees; a ring is a closed line.

Everything here is higher-order functions over the array, so shapes are worked on in the JVM, row by
row, and Catalyst sees plain projections. Windows to clip by are convex and counter-clockwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import EARTH_RADIUS, haversine

POINT = "struct<x:double,y:double>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often f names it; keeps plans small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def point(x: Column | float, y: Column | float) -> Column:
    of = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(of(x).alias("x"), of(y).alias("y"))


def line(*positions: tuple[float, float]) -> Column:
    """A literal line."""
    return F.array(*[point(x, y) for x, y in positions])


def _steps(path: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of every two neighbouring positions."""
    n = F.size(path)
    return F.when(n > 1, F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), f)).otherwise(F.array().cast("array<double>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def twice_area(ring: Column) -> Column:
    """Twice the shoelace area: positive for counter-clockwise rings."""
    return _sum(_steps(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))


def is_clockwise(ring: Column) -> Column:
    return twice_area(ring) < 0


def wound(ring: Column, clockwise: bool) -> Column:
    """The ring, turned round if it runs the other way."""
    return F.when(is_clockwise(ring) == clockwise, ring).otherwise(F.reverse(ring))


def sphere_area(ring: Column) -> Column:
    """Square metres on the sphere, by the trapezoids between each edge and the equator."""
    part = lambda a, b: F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))
    return F.abs(_sum(_steps(ring, part))) * (EARTH_RADIUS * EARTH_RADIUS / 2)


def length(path: Column) -> Column:
    """Metres along the path."""
    return _sum(_steps(path, lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"])))


def bounds(path: Column) -> Column:
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def centroid(ring: Column) -> Column:
    """Area-weighted centre; the mean of the corners where the area is zero."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    area = _sum(_steps(ring, cross))
    of = lambda c: _sum(_steps(ring, lambda a, b: (a[c] + b[c]) * cross(a, b))) / (3 * area)
    mean = lambda c: _sum(F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p: p[c])) / (F.size(ring) - 1)
    return F.struct(*[F.when(area != 0, of(c)).otherwise(mean(c)).alias(c) for c in "xy"])


def in_ring(p: Column, ring: Column) -> Column:
    """Even-odd test; a position on the lower or left edge counts as inside."""
    crossed = lambda a, b: (((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])).cast("double")
    return _sum(F.transform(_steps(ring, crossed), lambda c: F.coalesce(c, F.lit(0.0)))) % 2 == 1


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _edges(path: Column) -> Column:
    n = F.size(path)
    return F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges_cross(one: Column, other: Column) -> Column:
    """Whether any edge of one path meets any edge of the other, touching included."""
    between = lambda v, s, t: (v >= F.least(s, t)) & (v <= F.greatest(s, t))
    on = lambda e, p: (_side(e["a"], e["b"], p) == 0) & between(p["x"], e["a"]["x"], e["b"]["x"]) & between(p["y"], e["a"]["y"], e["b"]["y"])

    def meet(e: Column, f: Column) -> Column:
        d = [_side(e["a"], e["b"], f["a"]), _side(e["a"], e["b"], f["b"]), _side(f["a"], f["b"], e["a"]), _side(f["a"], f["b"], e["b"])]
        proper = (d[0] * d[1] < 0) & (d[2] * d[3] < 0)
        return proper | on(e, f["a"]) | on(e, f["b"]) | on(f, e["a"]) | on(f, e["b"])

    return F.exists(_edges(one), lambda e: F.exists(_edges(other), lambda f: meet(e, f)))


def intersects(one: Column, other: Column) -> Column:
    """Rings that share a position: boxes first, then edges, then one within the other."""
    apart = lambda a, b: (a["xmin"] > b["xmax"]) | (b["xmin"] > a["xmax"]) | (a["ymin"] > b["ymax"]) | (b["ymin"] > a["ymax"])
    boxes = ~_let(F.struct(bounds(one).alias("a"), bounds(other).alias("b")), lambda x: apart(x["a"], x["b"]))
    return boxes & (edges_cross(one, other) | in_ring(one[0], other) | in_ring(other[0], one))


def within(one: Column, other: Column) -> Column:
    """Whether ring ``one`` lies inside ring ``other`` without meeting its edge."""
    return F.forall(one, lambda p: in_ring(p, other)) & ~edges_cross(one, other)


def half_plane(ring: Column, a: Column, b: Column, left: bool = True) -> Column:
    """The part of an open ring on the left (else right) of the line from a to b, as an open ring."""
    sign, none = (1 if left else -1), F.array().cast(f"array<{POINT}>")

    def cut(q: Column, p: Column) -> Column:
        t = q["h"] / (q["h"] - p["h"])
        return point(q["x"] + t * (p["x"] - q["x"]), q["y"] + t * (p["y"] - q["y"]))

    def kept(q: Column, p: Column) -> Column:
        own = F.array(point(p["x"], p["y"]))
        return F.when(p["h"] >= 0, F.when(q["h"] < 0, F.concat(F.array(cut(q, p)), own)).otherwise(own)).when(q["h"] > 0, F.array(cut(q, p))).otherwise(none)

    placed = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (_side(a, b, p) * sign).alias("h")))
    walk = lambda r: F.flatten(F.zip_with(F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.size(r) - 1)), r, kept))
    return F.when(F.size(ring) > 0, _let(placed, walk)).otherwise(ring)


def _open(ring: Column) -> Column:
    return F.slice(ring, 1, F.size(ring) - 1)


def close_ring(ring: Column) -> Column:
    """A closed ring; an empty array where fewer than three corners are left."""
    return _let(ring, lambda r: F.when(F.size(r) > 2, F.concat(r, F.slice(r, 1, 1))).otherwise(F.array().cast(f"array<{POINT}>")))


def clip(ring: Column, window: Column) -> Column:
    """The part of a convex ring inside a convex window: one half-plane after the other. Parts of a concave ring
    would be joined along the window's edge; operators/overlays takes shapes of any form."""
    return close_ring(F.aggregate(_edges(window), _open(ring), lambda r, e: half_plane(r, e["a"], e["b"])))


def difference(ring: Column, window: Column) -> Column:
    """Rings that make up the part outside a convex window: beyond each of its edges, within those before."""
    start = F.struct(_open(ring).alias("rest"), F.array().cast(f"array<array<{POINT}>>").alias("out"))
    step = lambda s, e: F.struct(half_plane(s["rest"], e["a"], e["b"]).alias("rest"), F.concat(s["out"], F.array(half_plane(s["rest"], e["a"], e["b"], left=False))).alias("out"))
    pieces = F.aggregate(_edges(window), start, step, lambda s: s["out"])
    return F.filter(F.transform(pieces, close_ring), lambda r: (F.size(r) > 0) & (F.abs(twice_area(r)) > 1e-12))


def split(ring: Column, a: Column, b: Column) -> Column:
    """The parts left and right of the line through two positions; one ring if the line misses."""
    parts = _let(_open(ring), lambda r: F.array(close_ring(half_plane(r, a, b)), close_ring(half_plane(r, a, b, left=False))))
    return F.filter(parts, lambda r: (F.size(r) > 0) & (F.abs(twice_area(r)) > 1e-12))


def densify(path: Column, most: float) -> Column:
    """Positions added so that no step is longer than ``most`` degrees."""

    def between(a: Column, b: Column) -> Column:
        far = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
        n = F.greatest(F.ceil(far / most).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(a["x"] + (b["x"] - a["x"]) * i / n, a["y"] + (b["y"] - a["y"]) * i / n))

    n = F.size(path)
    added = F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), between)
    return F.when(n > 1, F.concat(F.flatten(added), F.slice(path, -1, 1))).otherwise(path)


def assemble(rings: Column) -> Column:
    """Polygons (outer, holes) from loose rings: clockwise ones are outer, any other is a hole of the first outer that holds its first corner."""
    owner = lambda outers, h: F.array_position(F.transform(outers, lambda o: in_ring(h[0], o)), True)
    owned = lambda outers, holes: F.transform(holes, lambda h: F.struct(h.alias("ring"), owner(outers, h).alias("of")))
    given = lambda outers, holes: F.transform(outers, lambda o, i: F.struct(o.alias("outer"), F.transform(F.filter(holes, lambda h: h["of"] == i + 1), lambda h: h["ring"]).alias("holes")))
    # turns, rings and owners are each worked out once
    turned = F.transform(rings, lambda r: F.struct(r.alias("ring"), is_clockwise(r).alias("outer")))
    of = lambda told, outer: F.transform(F.filter(told, lambda t: t["outer"] if outer else ~t["outer"]), lambda t: t["ring"])
    return _let(turned, lambda told: _let(of(told, True), lambda outers: _let(owned(outers, of(told, False)), lambda holes: given(outers, holes))))
