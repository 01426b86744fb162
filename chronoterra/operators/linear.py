"""Linear referencing: measures along routes, and places of events given by measure.

A route's vertices and its events are merged by measure in one sorted window, so an event meets only
the vertices before and after it and not every segment of its route.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import haversine

#: Rows of a pack of segments or points, and parts of a route's points that meet its segments in different tasks.
PACK, PARTS = 2048, 8


def measured(vertices: DataFrame) -> DataFrame:
    """(route, seq, lng, lat, measure): metres along the route up to each vertex, 0 at the first."""
    along = Window.partitionBy("route").orderBy("seq")
    step = haversine(F.lag("lng").over(along), F.lag("lat").over(along), F.col("lng"), F.col("lat"))
    stepped = vertices.filter("lng is not null and lat is not null").select("route", "seq", "lng", "lat", F.coalesce(step, F.lit(0.0)).alias("step"))
    return stepped.select("route", "seq", "lng", "lat", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("measure"))


def route_lengths(vertices: DataFrame) -> DataFrame:
    """(route, n, total_length)."""
    return measured(vertices).groupBy("route").agg(F.count("*").alias("n"), F.max("measure").alias("total_length"))


def locate_along(vertices: DataFrame, events: DataFrame) -> DataFrame:
    """(route, event, lng, lat) of each event (route, event, measure); a measure off the route has no place and no row."""
    none = F.lit(None)
    place = F.struct("measure", "lng", "lat")
    stops = measured(vertices).select("route", "measure", F.lit(0).alias("kind"), none.cast(dict(events.dtypes)["event"]).alias("event"), place.alias("vertex"))
    asked = events.filter("measure is not null").select("route", F.col("measure").cast("double").alias("measure"), F.lit(1).alias("kind"), "event", none.cast("struct<measure:double,lng:double,lat:double>").alias("vertex"))
    order = Window.partitionBy("route").orderBy("measure", "kind")
    before = F.last("vertex", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("a")
    back = Window.partitionBy("route").orderBy(F.desc("measure"), F.desc("kind"))
    after = F.last("vertex", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("b")
    met = stops.union(asked).select("route", "event", "kind", "measure", before, after).filter((F.col("kind") == 1) & F.col("a").isNotNull())
    met = met.filter(F.col("b").isNotNull() | (F.col("a.measure") == F.col("measure"))).withColumn("b", F.coalesce("b", "a"))
    share = F.when(F.col("b.measure") > F.col("a.measure"), (F.col("measure") - F.col("a.measure")) / (F.col("b.measure") - F.col("a.measure"))).otherwise(0.0)
    return met.select("route", "event", *[(F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in ("lng", "lat")])


def linear_events(vertices: DataFrame, events: DataFrame) -> DataFrame:
    """(route, event, x1, y1, x2, y2) of events (route, event, start, end) whose both ends lie on the route."""
    ends = [locate_along(vertices, events.select("route", "event", F.col(c).alias("measure"))).select("route", "event", F.col("lng").alias(f"x{i}"), F.col("lat").alias(f"y{i}")) for i, c in ((1, "start"), (2, "end"))]
    return ends[0].join(ends[1], ["route", "event"])


def _pieces(vertices: DataFrame) -> DataFrame:
    """Segments of the measured routes: from (lng, lat, measure) to (lng2, lat2, measure2)."""
    along = Window.partitionBy("route").orderBy("seq")
    return measured(vertices).withColumns({f"{c}2": F.lead(c).over(along) for c in ("lng", "lat", "measure")}).filter("measure2 is not null")


def _packed(rows: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """(route, ``key``, ``columns`` as arrays): rows of a route in packs of about ``size``."""
    packs = rows.groupBy("route").agg(F.ceil(F.count("*") / size).alias("packs"))
    dealt = rows.join(F.broadcast(packs), "route").withColumn(key, F.pmod(F.xxhash64(*columns), F.col("packs")))
    packed = dealt.groupBy("route", key).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return packed.select("route", key, *[F.col("rows")[c].alias(c) for c in columns])


def _off_at() -> list[Column]:
    """off and at of one point and one segment of a row."""
    dx, dy = F.col("lng2") - F.col("lng"), F.col("lat2") - F.col("lat")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("lng")) * dx + (F.col("py") - F.col("lat")) * dy) / size))).otherwise(0.0)
    off = F.pow(F.col("lng") + t * dx - F.col("px"), 2) + F.pow(F.col("lat") + t * dy - F.col("py"), 2)
    return [off.alias("off"), (F.col("measure") + t * (F.col("measure2") - F.col("measure"))).alias("at")]


def _nearest_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, point, off, at): of packs of points and segments, each point's nearest place and its measure, the first of equal ones."""
    for b in batches:
        for i in range(b.num_rows):
            px, py, *seg = (b.column(k)[i].values.to_numpy() for k in range(2, 10))
            x, y, m, x2, y2, m2 = seg
            dx, dy = x2 - x, y2 - y
            size = dx * dx + dy * dy
            flat = ~(size > 0)
            off, at = np.empty(len(px)), np.empty(len(px))
            for lo in range(0, len(px), 64):
                p, q = px[lo : lo + 64, None], py[lo : lo + 64, None]
                t = np.clip(((p - x) * dx + (q - y) * dy) / np.where(flat, 1.0, size), 0.0, 1.0)
                t[:, flat] = 0.0
                d = (x + t * dx - p) ** 2 + (y + t * dy - q) ** 2
                if np.isnan(least := d.min(axis=1)).any():  # a segment that isn't a number is the last choice
                    d = np.where(np.isnan(d), np.inf, d)
                    least = d.min(axis=1)
                row, k = np.nonzero(d == least[:, None])
                measure = np.full(len(least), np.inf)
                np.minimum.at(measure, row, m[k] + t[row, k] * (m2[k] - m[k]))
                off[lo : lo + 64], at[lo : lo + 64] = least, measure
            points = b.column(1)[i].values
            route = pa.repeat(b.column(0)[i], len(points))
            yield pa.RecordBatch.from_arrays([route, points, pa.array(off), pa.array(at)], ["route", "point", "off", "at"])


def locate_points(vertices: DataFrame, points: DataFrame) -> DataFrame:
    """(route, point, fraction, measure) of points (route, point, lng, lat): the nearest place on their route.

    The fraction is by measure, the first place wins where several are as near; a route without length gives measure 1 x fraction.
    Segments and points of a route meet as packs of PACK rows: what is shuffled is as long as the two tables, and
    of a point and a pack of segments only the nearest place is handed on.
    """
    name, number = points.schema["route"], points.schema["point"]
    segments = _packed(_pieces(vertices).filter("lng2 is not null").withColumns({c: F.col(c).cast("double") for c in ("lng", "lat", "lng2", "lat2")}), "own", ["lng", "lat", "measure", "lng2", "lat2", "measure2"], PACK)
    whole = F.col("lng").isNotNull() & F.col("lat").isNotNull() & ~F.isnan(F.col("lng").cast("double")) & ~F.isnan(F.col("lat").cast("double"))
    asked = points.filter(whole).select("route", "point", F.col("lng").cast("double").alias("px"), F.col("lat").cast("double").alias("py"))
    packs = _packed(asked, "pack", ["point", "px", "py"], PACK).withColumn("salt", F.pmod(F.col("pack"), F.lit(PARTS)))
    dealt = segments.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = packs.join(dealt, ["route", "salt"]).select("route", "point", "px", "py", "lng", "lat", "measure", "lng2", "lat2", "measure2")
    schema = StructType([StructField("route", name.dataType), StructField("point", number.dataType), StructField("off", DoubleType()), StructField("at", DoubleType())])
    # a point without a place is as far from every segment
    odd = points.filter(~F.coalesce(whole, F.lit(False))).select("route", "point", F.col("lng").alias("px"), F.col("lat").alias("py"))
    found = met.mapInArrow(_nearest_places, schema).union(_pieces(vertices).join(odd, "route").select("route", "point", *_off_at()))
    best = found.groupBy("route", "point").agg(F.min(F.struct("off", "at")).alias("b"))
    total = route_lengths(vertices).select("route", "total_length")
    fraction = F.when(F.col("total_length") > 0, F.col("b.at") / F.col("total_length")).otherwise(0.0)
    return best.join(total, "route").select("route", "point", fraction.alias("fraction"), (fraction * F.when(F.col("total_length") > 0, F.col("total_length")).otherwise(1.0)).alias("measure"))


def sublines(vertices: DataFrame, spans: DataFrame) -> DataFrame:
    """(route, span, path): the part of a route between two measures of spans (route, span, start, end).

    Measures are cut to the length of the route; the path holds the place of the start, the vertices
    between, and the place of the end. A span that begins after its end has no row.
    """
    total = route_lengths(vertices).select("route", "total_length")
    asked = spans.join(total, "route").select("route", "span", *[F.least(F.greatest(F.col(c), F.lit(0.0)), F.col("total_length")).alias(c) for c in ("start", "end")]).filter(F.col("start") <= F.col("end"))
    ends = [locate_along(vertices, asked.select("route", F.col("span").alias("event"), F.col(c).alias("measure"))).join(asked.select("route", F.col("span").alias("event"), F.col(c).alias("measure")), ["route", "event"]).select("route", F.col("event").alias("span"), "measure", F.lit(k).alias("k"), F.lit(0).cast("long").alias("seq"), "lng", "lat") for k, c in ((0, "start"), (2, "end"))]
    inside = measured(vertices).join(asked, "route").filter((F.col("measure") > F.col("start")) & (F.col("measure") < F.col("end"))).select("route", "span", "measure", F.lit(1).alias("k"), F.col("seq").cast("long").alias("seq"), "lng", "lat")
    rows = ends[0].union(inside).union(ends[1])
    ordered = F.array_sort(F.collect_list(F.struct("k", "measure", "seq", F.col("lng").alias("x"), F.col("lat").alias("y"))))
    return rows.groupBy("route", "span").agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))
