"""Point clouds as patches: (patch, xmin, ymin, xmax, ymax, n_points), and their points (x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import within_distance


def overlapping(patches: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return patches.filter((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def stats(patches: DataFrame) -> DataFrame:
    """(patches, points, xmin, ymin, xmax, ymax)."""
    return patches.agg(F.count("*").alias("patches"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("points"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def profile(points: DataFrame, start: tuple[float, float], end: tuple[float, float], n: int = 100, reach: float = 1e-4) -> DataFrame:
    """(i, x, y, z): n + 1 samples along a line with the mean z of the points within ``reach`` degrees, null where there are none."""
    i = F.col("feature_id")
    at = lambda k: F.lit(start[k]) + (end[k] - start[k]) * i / n
    samples = points.sparkSession.range(n + 1).withColumnRenamed("id", "feature_id").select("feature_id", at(0).alias("lng"), at(1).alias("lat"))
    own = points.select(F.struct("x", "y", "z").alias("feature_id"), F.col("x").alias("lng"), F.col("y").alias("lat"))
    met = within_distance(samples, own, reach).groupBy("a").agg(F.avg("b.z").alias("z"))
    return samples.join(met, i == F.col("a"), "left").select(i.alias("i"), F.col("lng").alias("x"), F.col("lat").alias("y"), "z")
