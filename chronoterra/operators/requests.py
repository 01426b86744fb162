"""Requests over a snapshot: filters, windows in either projection, order, pages, and what is returned."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MERCATOR_RADIUS, inverse_mercator, mercator
from ..functions.cql2 import FilterError, to_column
from .spatial import bbox

#: Codes of Web Mercator and of geographic coordinates, and the codes with latitude first.
MERCATOR_CODES, DEGREES, LATITUDE_FIRST = (3857, 102100), 4326, (4326, 4258, 4269)
#: Metres (1e-11 degrees) that rounding moves a projected place, at most; it is under 1e-7 up to 89 degrees of latitude.
ROUNDING = 1e-6
CQL2_DEFAULT, CQL2_MOST, RECORDS_MOST = 100, 10_000, 1000


def cql2_request(rows: DataFrame, request: dict[str, Any]) -> DataFrame:
    """``request`` has filter, filter-lang (cql2-json alone), limit (100, 10,000 at most) and offset."""
    if request.get("filter-lang", "cql2-json") != "cql2-json":
        raise FilterError("the filter language is cql2-json")
    limit, offset = int(request.get("limit", CQL2_DEFAULT)), int(request.get("offset", 0))
    if limit < 0 or offset < 0:
        raise FilterError("limit and offset aren't negative")
    rows = rows.filter(to_column(request["filter"])) if request.get("filter") else rows
    return rows.orderBy("feature_id").offset(offset).limit(min(limit, CQL2_MOST))


def window_in_degrees(window: tuple[float, float, float, float], code: int) -> tuple[float, float, float, float]:
    """A literal window in degrees, from degrees or Web Mercator metres."""
    if code == DEGREES:
        return window
    if code not in MERCATOR_CODES:
        raise ValueError(f"no projection {code}")
    x = [math.degrees(v / MERCATOR_RADIUS) for v in window[::2]]
    y = [math.degrees(math.atan(math.sinh(v / MERCATOR_RADIUS))) for v in window[1::2]]
    return x[0], y[0], x[1], y[1]


def native_window(rows: DataFrame, window: tuple[float, float, float, float], code: int, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of a table stored in the projection ``code`` within a window in degrees, with lng and lat.

    The window is brought to the table's own projection, so that it is compared with stored columns and
    reaches their scan; only rows within it are projected back. Its edges belong to it, as stored: what
    rounding moves a place when it is projected (ROUNDING at most) doesn't take it off an edge.
    """
    if code == DEGREES:
        low, high = window[:2], window[2:]
    elif code in MERCATOR_CODES:
        metres = lambda lng, lat: (math.radians(lng) * MERCATOR_RADIUS, math.asinh(math.tan(math.radians(lat))) * MERCATOR_RADIUS)
        low, high = [v - ROUNDING for v in metres(*window[:2])], [v + ROUNDING for v in metres(*window[2:])]
    else:
        raise ValueError(f"no projection {code}")
    inside = rows.filter(F.col(x).between(low[0], high[0]) & F.col(y).between(low[1], high[1]))
    lng, lat = (F.col(x), F.col(y)) if code == DEGREES else inverse_mercator(F.col(x), F.col(y))
    return inside.withColumn("lng", lng).withColumn("lat", lat)


def projected(rows: DataFrame, code: int) -> DataFrame:
    """Coordinates as x and y of the projection ``code``."""
    if code != DEGREES and code not in MERCATOR_CODES:
        raise ValueError(f"no projection {code}")
    x, y = (F.col("lng"), F.col("lat")) if code == DEGREES else mercator(F.col("lng"), F.col("lat"))
    return rows.withColumn("x", x).withColumn("y", y)


def items(rows: DataFrame, window: tuple[float, float, float, float] | None = None, window_code: str = "CRS84", code: str = "CRS84", limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of items in order of feature_id, with first and second coordinate c1 and c2.

    Codes are CRS84 (longitude first) or EPSG numbers; a geographic EPSG code has latitude first, in the
    window as in the result.
    """
    number = lambda c: DEGREES if c == "CRS84" else int(c)
    swapped = lambda c: c != "CRS84" and int(c) in LATITUDE_FIRST
    if window is not None:
        w = (window[1], window[0], window[3], window[2]) if swapped(window_code) else window
        rows = bbox(rows, *window_in_degrees(w, DEGREES if swapped(window_code) else number(window_code)))
    out = projected(rows, DEGREES if swapped(code) else number(code))
    first, second = ("y", "x") if swapped(code) else ("x", "y")
    return out.withColumn("c1", F.col(first)).withColumn("c2", F.col(second)).drop("x", "y").orderBy("feature_id").offset(offset).limit(limit)


def item(rows: DataFrame, feature_id: int, code: str = "CRS84") -> DataFrame:
    return items(rows.filter(F.col("feature_id") == feature_id), code=code, limit=1)


def records(rows: DataFrame, where: Column | None = None, order: list[tuple[str, bool]] = (), envelope: tuple[float, float, float, float] | None = None, in_code: int = DEGREES, out_code: int = DEGREES, offset: int = 0, count: int = RECORDS_MOST, only: str | None = None) -> DataFrame:
    """A page of a feature service over rows with oid.

    ``order`` are (column, ascending), nulls last either way, then oid. One row more than ``count`` (1 to
    1000) tells that there are more. ``only`` is None, 'count' or 'ids': these answer all rows.
    """
    rows = rows if envelope is None else bbox(rows, *window_in_degrees(envelope, in_code))
    rows = rows if where is None else rows.filter(where)
    if only == "count":
        return rows.agg(F.count("*").alias("n"))
    if only == "ids":
        return rows.select("oid")
    terms = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    page = rows.orderBy(*terms, F.col("oid").asc_nulls_last()).offset(offset).limit(max(1, min(count, RECORDS_MOST)) + 1)
    return projected(page, out_code)
