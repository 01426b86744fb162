"""The change feed: half-open windows in batch, and a stream that keeps the newest version per feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window(feed: DataFrame, after: int, upto: int | None = None, limit: int | None = None) -> DataFrame:
    """Changes in (after, upto], in order."""
    rows = feed.filter(F.col("sequence_id") > after)
    rows = rows if upto is None else rows.filter(F.col("sequence_id") <= upto)
    rows = rows.orderBy("sequence_id")
    return rows if limit is None else rows.limit(limit)


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The version log as a stream of new Parquet files; the checkpoint of the query is the consumer's cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_per_feature(log: DataFrame) -> DataFrame:
    """Streaming state of one row per feature: the version with the greatest (created_at, version_id). Use output mode complete or update."""
    rest = [c for c in log.columns if c != "feature_id"]
    best = log.groupBy("feature_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "version_id")).alias("v"))
    return best.select("feature_id", *[F.col(f"v.{c}").alias(c) for c in rest])
