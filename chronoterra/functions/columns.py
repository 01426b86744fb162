"""Column expressions shared by the operators: guarded casts, geodesy, projection, models of the verticals."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres, and the text that counts as a number in an attribute.
EARTH_RADIUS, MERCATOR_RADIUS, METRES_PER_DEGREE = 6_371_000.0, 6_378_137.0, 111_320.0
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def prop(name: str, properties: str = "properties") -> Column:
    """An attribute as text; null where the key is missing or JSON null."""
    return F.get_json_object(properties, f"$.{name}")


def json_entries(properties: Column) -> Column:
    """Key to raw JSON value: numbers, booleans, nested values and JSON null keep their type."""
    values = F.from_json(properties, "map<string,variant>")
    return F.transform_values(values, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def json_object(entries: Column) -> Column:
    """A JSON object from keys and raw values."""
    key = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    parts = F.transform(F.map_entries(entries), lambda e: F.concat(key(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def keep_properties(properties: Column, names: list[str]) -> Column:
    """The listed keys of a JSON object, in its own order; no names keep all."""
    if not names:
        return properties
    return json_object(F.map_filter(json_entries(properties), lambda k, _: k.isin(names)))


def number(text: Column) -> Column:
    """Guarded cast: null unless the text is a plain number ('NaN' or ' 5 ' are not)."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() skips nulls


def mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    return F.radians(lng) * MERCATOR_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS)))


def valid_at(at: Column | None, start: Column, end: Column) -> Column:
    """Half-open validity; no instant matches everything, a null bound is open."""
    if at is None:
        return F.lit(True)
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def grid_cell(lng: Column, lat: Column, zoom: int) -> Column:
    """Quadtree cell id at ``zoom`` (the documented stand-in for a hexagon index): row * 2**zoom + column."""
    n = 1 << zoom
    clip = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("long")
    return clip((lat + 90) / 180 * n) * n + clip((lng + 180) / 360 * n)


def ndvi_class(ndvi: Column) -> Column:
    return F.when(ndvi.isNull(), "no_data").when(ndvi > 0.6, "healthy").when(ndvi > 0.3, "moderate_stress").otherwise("severe_stress")


def urban_path_loss(mhz: Column, height_m: Column, km: Column) -> Column:
    """Okumura-Hata median loss in dB for a large city, mobile at ground level."""
    return 69.55 + 26.16 * F.log10(mhz) - 13.82 * F.log10(height_m) + (44.9 - 6.55 * F.log10(height_m)) * F.log10(km)


def whole(value: Column) -> Column:
    """A float read back as an integer: null unless it is whole."""
    return F.when(value == F.floor(value), value.cast("long"))


def age_days(day: Column, today: Column) -> Column:
    """Whole days since an ISO date; null if it can't be read."""
    return F.datediff(today.cast("date"), F.substring(day, 1, 10).try_cast("date"))


def text_embedding(text: Column, size: int = 256) -> Column:
    """Deterministic vector: component i is byte i mod 32 of SHA-256(text, i), over 255."""
    suffixes = [(str(i).encode(), i % 32) for i in range(size)]

    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            start = None if t is None else hashlib.sha256(t.encode())
            row = bytearray(size)
            for i, (suffix, place) in enumerate(suffixes if start else ()):
                h = start.copy()
                h.update(suffix)
                row[i] = h.digest()[place]
            out.append(np.frombuffer(row, np.uint8) / 255.0 if start else [None] * size)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(vectors, "array<double>")(text)
