"""GeoJSON and CSV as DataFrames of features, and back. Spark reads and writes the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LNG_NAMES, LAT_NAMES = ("longitude", "lng", "lon", "x"), ("latitude", "lat", "y")
_FEATURE = "features array<struct<id:string,geometry:struct<type:string,coordinates:array<double>>,properties:string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features of FeatureCollections: (id, properties JSON, lng, lat); features without a point are left out."""
    rows = spark.read.schema(_FEATURE).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.filter("f.geometry.type = 'Point'").select("f.id", F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollections with any geometry: (id, properties JSON, geometry as GeoJSON text); features without one are left out."""
    rows = spark.read.schema("features array<struct<id:string,geometry:string,properties:string>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.filter("f.geometry is not null").select("f.id", F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


def geojson_lines(rows: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    shape = F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("lng").cast("string"), F.col("lat").cast("string"))
    shape = F.when(F.col("lng").isNull(), "null").otherwise(shape)
    name = F.regexp_extract(F.to_json(F.array(F.col("feature_id").cast("string"))), r"(?s)^\[(.*)\]$", 1)
    return rows.select(F.format_string('{"type":"Feature","id":%s,"geometry":%s,"properties":%s}', name, shape, F.coalesce("properties", F.lit("{}"))).alias("value"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A plain comma split (quotes don't protect commas); rows without numeric coordinates are left out, and so is the header by its names."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    names = [c.strip().strip('"') for c in lines.first().value.split(",")]
    find = lambda known: next(i for i, n in enumerate(names) if n.lower() in known)
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    rows = lines.select(cells.alias("c"))  # the header's own cells aren't numbers
    x, y = F.try_element_at("c", F.lit(find(LNG_NAMES) + 1)).try_cast("double"), F.try_element_at("c", F.lit(find(LAT_NAMES) + 1)).try_cast("double")
    props = F.to_json(F.struct(*[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names) if n.lower() not in LNG_NAMES + LAT_NAMES]))
    return rows.select(props.alias("properties"), x.alias("lng"), y.alias("lat")).filter("lng is not null and lat is not null")


def csv_lines(rows: DataFrame) -> DataFrame:
    """id,longitude,latitude,properties; a missing coordinate prints 0, quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("properties", F.lit("{}")), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.select(F.concat_ws(",", F.col("feature_id").cast("string"), F.coalesce("lng", F.lit(0.0)).cast("string"), F.coalesce("lat", F.lit(0.0)).cast("string"), quoted).alias("value"))
