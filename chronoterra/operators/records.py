"""Listings and small models of the verticals: sensors, surveys, fields, incidents, evacuation, parcels, sales, catalogs.

A listing is a page of the snapshot in order of feature_id; its conditions hold within the page, as
the page is taken first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import METRES_PER_DEGREE, age_days, haversine, number, prop, urban_path_loss
from .spatial import bbox

#: Walking speed in metres a minute.
WALK = 5000.0 / 60.0


def listing(rows: DataFrame, fields: dict[str, str], limit: int = 100, most: int = 500, equal: dict[str, str] | None = None, having: str | None = None) -> DataFrame:
    """feature_id and the ``fields`` (name to 'text' or 'number') of a page of 1 to ``most`` features.

    Of the page, features stay whose attributes are ``equal`` to the given texts and, with ``having``, that
    have this attribute.
    """
    page = rows.orderBy("feature_id").limit(max(1, min(limit, most)))
    for name, value in (equal or {}).items():
        page = page.filter(prop(name) == value)
    page = page if having is None else page.filter(prop(having).isNotNull())
    return page.select("feature_id", *[(number(prop(n)) if kind == "number" else prop(n)).alias(n) for n, kind in fields.items()])


def survey_compare(rows: DataFrame, a: int, b: int) -> DataFrame:
    """(count_a, count_b, mean_diff, max_cut, max_fill, volume); no row unless both surveys exist. Missing numbers count as 0."""
    of = lambda i, n: rows.filter(F.col("feature_id") == i).select(*[F.coalesce(number(prop(p)), F.lit(0.0)).alias(f"{p}_{n}") for p in ("point_count", "mean_elevation")])
    d = F.col("mean_elevation_b") - F.col("mean_elevation_a")
    return of(a, "a").crossJoin(of(b, "b")).select(
        F.col("point_count_a").cast("long").alias("count_a"), F.col("point_count_b").cast("long").alias("count_b"), d.alias("mean_diff"),
        F.abs(F.least(d, F.lit(0.0))).alias("max_cut"), F.greatest(d, F.lit(0.0)).alias("max_fill"), (d * F.col("point_count_b")).alias("volume"),
    )  # one row of each


def coverage(towers: DataFrame) -> DataFrame:
    """Towers (tower, lng, lat, height_m, mhz, dbm, radius_m) with signal at the edge, area in square kilometres and the circle as a ring of 33 positions."""
    km = F.col("radius_m") / 1000.0
    loss = urban_path_loss(F.col("mhz"), F.greatest(F.col("height_m"), F.lit(1.0)), km)
    r = F.col("radius_m") / METRES_PER_DEGREE
    ring = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.struct((F.col("lng") + r * F.cos(i * (2 * math.pi / 32))).alias("x"), (F.col("lat") + r * F.sin(i * (2 * math.pi / 32))).alias("y")))
    return towers.select("*", (F.col("dbm") - loss).alias("edge_dbm"), (km * km * math.pi).alias("area_km2"), ring.alias("ring"))


def assembly_points(points: DataFrame, lng: float, lat: float) -> DataFrame:
    """Points (id, lng, lat, capacity) with metres and walking minutes from a place, nearest first."""
    metres = haversine(F.lit(lng), F.lit(lat), F.col("lng"), F.col("lat"))
    return points.withColumn("metres", metres).withColumn("minutes", F.col("metres") / WALK).orderBy("metres", "id")


def parcel_search(rows: DataFrame, text: str | None = None, window: tuple[float, float, float, float] | None = None, limit: int = 100) -> DataFrame:
    """Parcels in a window, else those whose apn, address or owner holds ``text`` in any case; 1 to 500 by id."""
    if window is not None:
        rows = bbox(rows, *window)
    elif text:
        holds = lambda n: F.coalesce(F.lower(prop(n)).contains(text.lower()), F.lit(False))
        rows = rows.filter(holds("apn") | holds("address") | holds("owner"))
    return rows.orderBy("feature_id").limit(max(1, min(limit, 500)))


def comparable_sales(rows: DataFrame, lng: float, lat: float, radius: float, today: Column, sqft: tuple[float, float] | None = None, max_age_days: int | None = None, limit: int = 10) -> DataFrame:
    """(feature_id, metres, price) of sales near a place, nearest first.

    A page of five times ``limit`` features whose point lies in the circle is judged: a feature without
    size or with an unreadable or no date passes; distances come from the attributes lng and lat, 0 if missing.
    """
    degrees = radius / METRES_PER_DEGREE
    inside = F.pow(F.col("lng") - lng, 2) + F.pow(F.col("lat") - lat, 2) <= degrees * degrees
    page = bbox(rows, lng - degrees, lat - degrees, lng + degrees, lat + degrees).filter(inside).orderBy("feature_id").limit(5 * limit)
    if sqft is not None:
        size = number(prop("sqft"))
        page = page.filter(size.isNull() | size.between(*sqft))
    if max_age_days is not None:
        age = age_days(prop("sale_date"), today)
        page = page.filter(age.isNull() | (age <= max_age_days))
    at = lambda n: F.coalesce(number(prop(n)), F.lit(0.0))
    metres = haversine(F.lit(lng), F.lit(lat), at("lng"), at("lat"))
    return page.select("feature_id", metres.alias("metres"), number(prop("price")).alias("price")).orderBy("metres", "feature_id").limit(limit)


def sales_summary(sales: DataFrame) -> DataFrame:
    """(n, mean, median, low, high) of the prices of a page of sales; the median is the upper one."""
    prices = F.array_sort(F.collect_list("price"))  # a page: bounded by its limit
    n = F.count("price")
    return sales.agg(n.alias("n"), F.avg("price").alias("mean"), F.try_element_at(prices, (F.floor(n / 2) + 1).cast("int")).alias("median"), F.min("price").alias("low"), F.max("price").alias("high"))


def related(features: DataFrame, records: DataFrame, classes: DataFrame, direction: str = "both") -> DataFrame:
    """(feature_id, direction, class, label, related) over relation records (class, origin, destination) and their classes (class, forward, backward).

    A missing label is ''. Each side is an equi join on the feature.
    """
    named = records.join(classes, "class")
    blank = lambda c: F.coalesce(c, F.lit(""))
    ahead = named.select(F.col("origin").alias("feature_id"), F.lit("forward").alias("direction"), "class", blank("forward").alias("label"), F.col("destination").alias("related"))
    back = named.select(F.col("destination").alias("feature_id"), F.lit("backward").alias("direction"), "class", blank("backward").alias("label"), F.col("origin").alias("related"))
    links = {"forward": ahead, "backward": back, "both": ahead.union(back)}[direction]
    return links.join(features.select("feature_id"), "feature_id", "left_semi")


def visible(datasets: DataFrame, grants: DataFrame, user: str | None = None) -> DataFrame:
    """Datasets (dataset, public, ...) that are public or on which anyone, or the given user, holds a grant (dataset, user)."""
    own = grants if user is None else grants.filter(F.col("user") == user)
    closed = datasets.filter("not coalesce(public, false)").join(own.select("dataset"), "dataset", "left_semi")
    return datasets.filter("coalesce(public, false)").union(closed.select(datasets.columns))


def catalog_search(datasets: DataFrame, tags: DataFrame, text: str = "", tag: str | None = None, limit: int = 50) -> DataFrame:
    """Datasets (dataset, name, description) by a pattern in name or description (% and _ in it are wildcards) and a tag, with their sorted tags."""
    pattern = f"%{text}%"
    rows = datasets if not text else datasets.filter(F.col("name").ilike(pattern) | F.coalesce(F.col("description").ilike(pattern), F.lit(False)))
    if tag is not None:
        rows = rows.join(tags.filter(F.col("tag") == tag).select("dataset").distinct(), "dataset", "left_semi")
    page = rows.orderBy("name", "dataset").limit(limit)
    of = tags.join(F.broadcast(page.select("dataset")), "dataset").groupBy("dataset").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return page.join(of, "dataset", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count_distinct("dataset").alias("n"))


def stac_search(items: DataFrame, window: list[float] | None = None, collections: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Items (item, collection, xmin, ymin, xmax, ymax) that overlap a window of four numbers (any other window is no condition)."""
    if window is not None and len(window) == 4:
        xmin, ymin, xmax, ymax = window
        items = items.filter((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    if collections:
        items = items.filter(F.col("collection").isin(collections))
    return items.orderBy("collection", "item").limit(limit)
