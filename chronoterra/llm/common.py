"""Shared small parts: tables, shared scratch space, byte-level words, size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured and the master is local (tests)."""
    return shared_folder(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small frame: lineage ends here and lost executors can't take it along."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Writes a larger intermediate as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that scratch() gave; any other frame is left alone."""
    if (path := getattr(df, "scratch_path", None)) is not None:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: what a task returns with whole texts goes back in small buffers."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def quoted(name: str) -> Column:
    """A column by its name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has."""
    names, name = {c.lower() for c in df.columns}, base
    while name.lower() in names:
        name += "_"
    return name
