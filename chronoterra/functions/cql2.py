"""CQL2-JSON filters as Columns. The filter is plain JSON; Catalyst sees ordinary comparisons.

Comparisons with a number go through the guarded cast, all others compare text. Under AND, a spatial
window also becomes comparisons on the coordinates, which reach the scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import number, prop

_COMPARE = {"=": Column.__eq__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "!=": Column.__ne__}
_ALIAS = {"eq": "=", "lt": "<", "gt": ">", "lte": "<=", "gte": ">=", "neq": "!=", "<>": "!="}


class FilterError(ValueError):
    """The filter is not one this compiler accepts."""


def _is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _name(arg: Any) -> str:
    if isinstance(arg, dict) and isinstance(arg.get("property"), str):
        return arg["property"]
    raise FilterError(f"a property is needed, not {arg!r}")


def _text(v: Any) -> Column:
    return F.lit(str(v).lower() if isinstance(v, bool) else str(v))


def to_column(node: dict, properties: str = "properties", lng: str = "lng", lat: str = "lat") -> Column:
    """A boolean Column for a CQL2-JSON node."""
    try:
        op, args = _ALIAS.get(node["op"], node["op"]), node["args"]
    except (KeyError, TypeError) as e:
        raise FilterError("a node has op and args") from e
    inner = lambda n: to_column(n, properties, lng, lat)
    if op in ("and", "or"):
        if not args:
            raise FilterError(f"{op} needs arguments")
        return reduce(Column.__and__ if op == "and" else Column.__or__, map(inner, args))
    if op == "not":
        return ~inner(args[0])
    if op in _COMPARE:
        a, value = prop(_name(args[0]), properties), args[1]
        return _COMPARE[op](number(a), F.lit(float(value))) if _is_number(value) else _COMPARE[op](a, _text(value))
    if op == "like":
        return prop(_name(args[0]), properties).like(str(args[1]))
    if op == "between":
        low, high = args[1:] if len(args) == 3 else args[1]
        if not (_is_number(low) and _is_number(high)):
            raise FilterError("between needs numbers")
        return number(prop(_name(args[0]), properties)).between(float(low), float(high))
    if op == "in":
        values = args[1] if len(args) == 2 and isinstance(args[1], list) else args[1:]
        return prop(_name(args[0]), properties).isin([str(v) for v in values]) if values else F.lit(False)
    if op == "isNull":
        return prop(_name(args[0]), properties).isNull()
    if op in ("s_intersects", "s_within"):
        if _name(args[0]) not in ("geometry", "geom"):
            raise FilterError("spatial operators take the geometry")
        return _polygon(args[1], lng, lat, sides=op == "s_intersects")
    raise FilterError(f"unknown operator {op!r}")


def _polygon(shape: dict, lng: str, lat: str, sides: bool = True) -> Column:
    """Point in polygon: the window first, then even-odd crossings of the rings.

    Without ``sides`` the crossings to the left count as well, so that no position on a side is inside,
    whichever way the side faces; a level lower edge still is.
    """
    if shape.get("type") != "Polygon":
        raise FilterError("a Polygon is needed")
    rings = shape["coordinates"]
    for r in rings:
        if len(r) < 4 or r[0] != r[-1]:
            raise FilterError("rings are closed and have four positions at least")
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    x, y = F.col(lng), F.col(lat)
    right = left = F.lit(0)
    for r in rings:
        for (x1, y1), (x2, y2) in zip((p[:2] for p in r), (p[:2] for p in r[1:]), strict=False):
            if y1 != y2:
                level, at = (y >= min(y1, y2)) & (y < max(y1, y2)), (y - y1) * (float(x2 - x1) / (y2 - y1)) + x1
                right += (level & (x < at)).cast("int")
                left += (level & (x > at)).cast("int")
    inside = (right % 2 == 1) if sides else (right % 2 == 1) & (left % 2 == 1)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside
