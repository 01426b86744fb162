"""Point operators: window filter, extent, nearest neighbours, proximity join, clustering, anomalies, grid counts.

Joins by distance meet in grid cells: each row is in one cell and asks the neighbouring ones, so work
follows local density instead of the square of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import METRES_PER_DEGREE, grid_cell, haversine
from .clusters import connected_components
from .history import checkpoint


def bbox(rows: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Edges belong to the window."""
    return rows.filter(F.col("lng").between(xmin, xmax) & F.col("lat").between(ymin, ymax))


def extent(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    xy = {"xmin": F.min("lng"), "ymin": F.min("lat"), "xmax": F.max("lng"), "ymax": F.max("lat"), "cx": F.avg("lng"), "cy": F.avg("lat"), "n": F.count("lng")}
    return rows.groupBy(*by).agg(*[c.alias(k) for k, c in xy.items()])


def nearest(rows: DataFrame, feature_id: int, k: int = 5) -> DataFrame:
    """The k features nearest to one, by planar distance then id, with geodesic metres."""
    me = rows.filter(F.col("feature_id") == feature_id).select("lng", "lat").first()
    if me is None or me.lng is None:
        return rows.select("feature_id", F.lit(0.0).alias("metres")).limit(0)
    x, y = F.lit(me.lng), F.lit(me.lat)
    flat = F.sqrt(F.pow(F.col("lng") - x, 2) + F.pow(F.col("lat") - y, 2))
    ranked = rows.filter((F.col("feature_id") != feature_id) & F.col("lng").isNotNull()).select("feature_id", flat.alias("d"), haversine(x, y, F.col("lng"), F.col("lat")).alias("metres"))
    return ranked.orderBy("d", "feature_id").limit(k).select("feature_id", "metres")


def distance_matrix(rows: DataFrame, ids: list[int]) -> DataFrame:
    """(a, b, metres) of every unordered pair of the listed ids, which the caller bounds; absent ids have no pair."""
    own = rows.filter(F.col("feature_id").isin(ids) & F.col("lng").isNotNull()).select("feature_id", "lng", "lat")
    a, b = (own.toDF(n, f"{n}x", f"{n}y") for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("metres"))


def circles(rows: DataFrame, metres: float, corners: int = 32) -> DataFrame:
    """(feature_id, ring): a closed ring of ``corners`` + 1 positions around each point."""
    r = metres / METRES_PER_DEGREE
    turn = lambda i: i.cast("double") * (2 * math.pi / corners)
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.struct((F.col("lng") + r * F.cos(turn(i))).alias("x"), (F.col("lat") + r * F.sin(turn(i))).alias("y")))
    return rows.filter("lng is not null").select("feature_id", ring.alias("ring"))


def _near(rows: DataFrame, eps: float) -> Column:
    """Cell of a point at cells of side eps."""
    return F.struct(F.floor(F.col("lng") / eps).alias("i"), F.floor(F.col("lat") / eps).alias("j"))


def within_distance(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """(a, b, d): pairs of a left and a right feature_id at planar distance eps at most."""
    ask = F.explode(F.array(*[F.struct((F.floor(F.col("lng") / eps) + i).alias("i"), (F.floor(F.col("lat") / eps) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.filter("lng is not null").select(F.col("feature_id").alias("a"), F.col("lng").alias("ax"), F.col("lat").alias("ay"), ask.alias("cell"))
    b = right.filter("lng is not null").select(F.col("feature_id").alias("b"), F.col("lng").alias("bx"), F.col("lat").alias("by"), _near(right, eps).alias("cell"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return a.join(b, "cell").select("a", "b", d.alias("d")).filter(F.col("d") <= eps)


#: Points of a cell from which it is read in several parts, and halvings of cells before their points are compared.
CROWDED, HALVINGS = 20_000, 10


def _dense_links(points: DataFrame, dense: DataFrame, side: float, eps: float) -> DataFrame:
    """(u, v) of neighbouring dense cells (i, j, node) that have points within eps of each other.

    Both cells are halved together. Parts that are surely within eps link their cells, parts that surely
    are not are dropped, and the rest is halved again; points are compared only in the parts left at the end.
    """
    node = lambda n: dense.select(F.col("i").alias(f"{n}i"), F.col("j").alias(f"{n}j"), F.col("node").alias(n))
    steps = F.explode(F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in range(-2, 3) for dj in range(-2, 3) if (di, dj) > (0, 0)]))
    asked = node("u").withColumn("s", steps).withColumn("vi", F.col("ui") + F.col("s.di")).withColumn("vj", F.col("uj") + F.col("s.dj")).drop("s")
    open_ = checkpoint(asked.join(node("v"), ["vi", "vj"]).select("u", "v", "ui", "uj", "vi", "vj"))
    inside = points.join(dense.select("i", "j"), ["i", "j"], "left_semi")
    part = lambda d: [F.floor(F.col(c) / (side / (1 << d))).cast("long") for c in ("lng", "lat")]
    found = None
    for d in range(1, HALVINGS + 1):
        if open_.isEmpty():
            break
        size = side / (1 << d)
        used = checkpoint(inside.select(*[c.alias(k) for c, k in zip(part(d), "ij", strict=True)]).distinct())
        halves = lambda n: used.select(F.col("i").alias(f"{n}i2"), F.col("j").alias(f"{n}j2"), F.shiftright("i", 1).alias(f"{n}i"), F.shiftright("j", 1).alias(f"{n}j"))
        both = open_.join(halves("u"), ["ui", "uj"]).join(halves("v"), ["vi", "vj"])
        apart = [F.abs(F.col(f"u{c}2") - F.col(f"v{c}2")) for c in "ij"]
        near = F.sqrt(sum((F.pow(F.greatest(x - 1, F.lit(0)) * size, F.lit(2.0)) for x in apart), F.lit(0.0)))
        far = F.sqrt(sum((F.pow((x + 1) * size, F.lit(2.0)) for x in apart), F.lit(0.0)))
        told = checkpoint(both.select("u", "v", "ui2", "uj2", "vi2", "vj2", (far <= eps * (1 - 1e-12)).alias("sure"), (near <= eps * (1 + 1e-12)).alias("may")).filter("may"))
        sure = told.filter("sure").select("u", "v").distinct()
        found = sure if found is None else found.union(sure)
        open_ = checkpoint(told.join(sure, ["u", "v"], "left_anti").select("u", "v", *[F.col(f"{n}{c}2").alias(f"{n}{c}") for n in "uv" for c in "ij"]))
    if open_.isEmpty():
        return found if found is not None else open_.select("u", "v")
    last = lambda n: inside.select(*[c.alias(f"{n}{k}") for c, k in zip(part(HALVINGS), "ij", strict=True)], F.col("lng").alias(f"{n}x"), F.col("lat").alias(f"{n}y")).distinct()
    d = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    return found.union(open_.join(last("u"), ["ui", "uj"]).join(last("v"), ["vi", "vj"]).filter(d <= eps).select("u", "v").distinct())


def dbscan(rows: DataFrame, eps: float, min_points: int = 3) -> DataFrame:
    """(feature_id, cluster): cluster is the smallest core feature_id; border points join their smallest cluster; noise is absent.

    Cells have the side eps / sqrt(2), so that points of one cell are neighbours: in a cell of ``min_points``
    all are core, and cells are linked as wholes. Pairs are listed only for points of smaller cells, each of
    which has under ``min_points`` of them, so a crowded cell costs its points times a constant.
    """
    side = eps / math.sqrt(2)
    own = rows.filter("lng is not null and lat is not null").select("feature_id", "lng", "lat", *[F.floor(F.col(c) / side).cast("long").alias(k) for c, k in (("lng", "i"), ("lat", "j"))])
    cells = checkpoint(own.groupBy("i", "j").agg(F.count("*").alias("n"), F.min("feature_id").alias("node")))
    dense = cells.filter(F.col("n") >= min_points)
    sparse = own.join(cells.filter(F.col("n") < min_points).select("i", "j"), ["i", "j"], "left_semi")
    crowded = F.broadcast(cells.filter(F.col("n") > CROWDED).select("i", "j", F.ceil(F.col("n") / CROWDED).cast("int").alias("parts")))
    moves = F.explode(F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in range(-2, 3) for dj in range(-2, 3)]))
    asks = sparse.select(F.col("feature_id").alias("a"), F.col("lng").alias("ax"), F.col("lat").alias("ay"), F.col("i").alias("ai"), F.col("j").alias("aj"), moves.alias("s"))
    asks = asks.select("a", "ax", "ay", "ai", "aj", (F.col("ai") + F.col("s.di")).alias("i"), (F.col("aj") + F.col("s.dj")).alias("j"))
    asks = asks.join(crowded, ["i", "j"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = own.join(crowded, ["i", "j"], "left").withColumn("part", F.pmod(F.xxhash64("feature_id"), F.coalesce("parts", F.lit(1))).cast("int")).select("i", "j", "part", F.col("feature_id").alias("b"), F.col("lng").alias("bx"), F.col("lat").alias("by"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    pairs = checkpoint(asks.join(dealt, ["i", "j", "part"]).filter(d <= eps).select("a", "ai", "aj", "b", "i", "j"))  # a point is its own neighbour
    core = pairs.groupBy("a", "ai", "aj").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select("a", F.col("ai").alias("i"), F.col("aj").alias("j"))
    core = checkpoint(core)
    # a cell's core points are one node: the smallest of them
    nodes = checkpoint(dense.select("i", "j", "node").union(core.groupBy("i", "j").agg(F.min("a").alias("node"))))
    at = lambda n, i, j: nodes.select(F.col("i").alias(i), F.col("j").alias(j), F.col("node").alias(n))
    all_core = core.select(F.col("a").alias("b")).union(own.join(dense.select("i", "j"), ["i", "j"], "left_semi").select(F.col("feature_id").alias("b")))
    among = checkpoint(pairs.join(all_core, "b", "left_semi").join(at("v", "i", "j"), ["i", "j"]).select("a", "ai", "aj", "v"))
    sparse_links = among.join(core.select("a"), "a", "left_semi").join(at("u", "ai", "aj"), ["ai", "aj"]).select("u", "v")
    links = sparse_links.union(_dense_links(own, dense, side, eps).select("u", "v")).filter("u <> v").distinct()
    roots = connected_components(links).withColumnRenamed("node", "n")
    label = checkpoint(nodes.join(roots, nodes["node"] == roots["n"], "left").select("i", "j", "node", F.coalesce("root", "node").alias("cluster")))
    named = label.select(F.col("node").alias("v"), "cluster")
    border = among.join(named, "v").groupBy(F.col("a").alias("feature_id")).agg(F.min("cluster").alias("cluster"))
    return border.union(own.join(dense.select("i", "j"), ["i", "j"], "left_semi").join(label.select("i", "j", "cluster"), ["i", "j"]).select("feature_id", "cluster"))


def anomalies(rows: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Points farther from the centroid of all than ``sigmas`` sample deviations of that distance."""
    c = rows.agg(F.avg("lng").alias("x"), F.avg("lat").alias("y")).first()
    if c.x is None:
        return rows.select("feature_id", F.lit(0.0).alias("distance")).limit(0)
    d = rows.filter("lng is not null").select("feature_id", F.sqrt(F.pow(F.col("lng") - c.x, 2) + F.pow(F.col("lat") - c.y, 2)).alias("distance"))
    s = d.agg(F.coalesce(F.stddev_samp("distance"), F.lit(1.0))).first()[0]
    return d.filter(F.col("distance") > sigmas * s)


def grid_counts(rows: DataFrame, zoom: int = 7, limit: int = 500) -> DataFrame:
    """Features per quadtree cell, most first (a report of ``limit`` cells)."""
    return rows.filter("lng is not null").groupBy(grid_cell(F.col("lng"), F.col("lat"), zoom).alias("cell")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell").limit(limit)


def dissolve(rows: DataFrame, key: Column) -> DataFrame:
    """Count and centroid per attribute value; features without it are left out."""
    return rows.withColumn("key", key).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.avg("lng").alias("cx"), F.avg("lat").alias("cy"))


def object_ids(rows: DataFrame) -> DataFrame:
    """Adds oid, 1.. in order of feature_id, from per-range counts and offsets: no single task numbers all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(rows.repartitionByRange(n, "feature_id").withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("feature_id"))
    return placed.join(F.broadcast(before), "part").withColumn("oid", F.col("before") + local).drop("part", "before")
