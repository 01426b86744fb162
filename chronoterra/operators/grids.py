"""Map tiles of points, neighbourhoods of grid cells, and values looked up in a pyramid of raster tiles.

All of it is arithmetic on coordinates and equi joins on cell ids, so no geometry is compared with
every other. Points without coordinates are in no tile and have no value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grid_cell

#: Where the Web Mercator square ends, and the units along a vector tile's side.
MAX_LATITUDE, TILE_UNITS = 85.05112878, 4096


def tile_position(lng: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Position in tiles from the north-west corner of the Web Mercator square."""
    n = float(1 << zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return (lng + 180.0) / 360.0 * n, (F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / math.pi) / 2.0 * n


def tile_points(rows: DataFrame, zoom: int, units: int = TILE_UNITS) -> DataFrame:
    """(feature_id, tx, ty, px, py): the tile of each point and its place inside, in tile units."""
    at = dict(zip("xy", tile_position(F.col("lng"), F.col("lat"), zoom), strict=True))
    tile = {k: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit((1 << zoom) - 1)).cast("long") for k, v in at.items()}
    placed = rows.filter("lng is not null and lat is not null").select("feature_id", *[v.alias(k) for k, v in at.items()], *[v.alias("t" + k) for k, v in tile.items()])
    return placed.select("feature_id", "tx", "ty", *[F.floor((F.col(k) - F.col("t" + k)) * units).cast("long").alias("p" + k) for k in "xy"])


def tile_counts(rows: DataFrame, zoom: int) -> DataFrame:
    """(tx, ty, n) of every tile that holds points."""
    return tile_points(rows, zoom).groupBy("tx", "ty").agg(F.count("*").alias("n"))


def grid_disk(cells: DataFrame, zoom: int, k: int = 1) -> DataFrame:
    """(cell, neighbour): cells at ``k`` steps at most, itself included; columns go round the globe, rows end at the poles."""
    n = 1 << zoom
    step = lambda name: F.explode(F.sequence(F.lit(-k), F.lit(k))).alias(name)
    moves = cells.select("cell", step("dy")).select("cell", "dy", step("dx"))
    row, col = F.floor(F.col("cell") / n) + F.col("dy"), F.pmod(F.col("cell") % n + F.col("dx"), F.lit(n))
    return moves.select("cell", row.alias("row"), col.alias("col")).filter((F.col("row") >= 0) & (F.col("row") < n)).select("cell", (F.col("row") * n + F.col("col")).cast("long").alias("neighbour")).distinct()


def raster_values(points: DataFrame, tiles: DataFrame, zooms: list[int]) -> DataFrame:
    """(feature_id, zoom, value): the value of the finest tile (zoom, cell, value) that covers each point; null where none does."""
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), grid_cell(F.col("lng"), F.col("lat"), z).alias("cell")) for z in zooms]))
    asked = points.filter("lng is not null and lat is not null").select("feature_id", levels.alias("at")).select("feature_id", "at.*")
    found = asked.join(tiles.select("zoom", "cell", "value"), ["zoom", "cell"]).groupBy("feature_id").agg(F.max("zoom").alias("zoom"), F.max_by("value", "zoom").alias("value"))
    return points.select("feature_id").join(found, "feature_id", "left")


def band_stats(tiles: DataFrame) -> DataFrame:
    """(tiles, min_zoom, max_zoom) of a raster."""
    return tiles.agg(F.count("*").alias("tiles"), F.min("zoom").alias("min_zoom"), F.max("zoom").alias("max_zoom"))


def compact(cells: DataFrame, zoom: int) -> DataFrame:
    """(zoom, cell): four cells that make up their parent are replaced by it, level by level."""
    out, level = None, cells.select("cell").distinct()
    for z in range(zoom, 0, -1):
        n = 1 << z
        parent = (F.floor(F.floor(F.col("cell") / n) / 2) * (n // 2) + F.floor(F.col("cell") % n / 2)).cast("long")
        told = level.withColumn("parent", parent)
        full = told.groupBy("parent").agg(F.count("*").alias("n")).filter("n = 4").select("parent")
        rest = told.join(full, "parent", "left_anti").select(F.lit(z).alias("zoom"), "cell")
        out = rest if out is None else out.union(rest)
        level = full.select(F.col("parent").alias("cell"))
    return out.union(level.select(F.lit(0).alias("zoom"), "cell")) if out is not None else level.select(F.lit(0).alias("zoom"), "cell")


def cell_boundary(cells: DataFrame, zoom: int) -> DataFrame:
    """(cell, xmin, ymin, xmax, ymax) in degrees."""
    n = 1 << zoom
    row, col = F.floor(F.col("cell") / n), F.col("cell") % n
    return cells.select("cell", (col * 360.0 / n - 180.0).alias("xmin"), (row * 180.0 / n - 90.0).alias("ymin"), ((col + 1) * 360.0 / n - 180.0).alias("xmax"), ((row + 1) * 180.0 / n - 90.0).alias("ymax"))


def indexed(rows: DataFrame, zoom: int) -> DataFrame:
    """Rows with the cell of their point at ``zoom``; null without a point."""
    return rows.withColumn("cell", grid_cell(F.col("lng"), F.col("lat"), zoom))
