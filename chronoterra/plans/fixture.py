"""The order table as a versioned point dataset: five changesets on two branches.

1 <- 2 <- 3 is main (head 3), 2 <- 4 <- 5 is fork (head 5). created_at equals the changeset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = {"main": 3, "fork": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changesets(spark: SparkSession) -> DataFrame:
    rows = [(1, None, None, "main", 1), (2, 1, None, "main", 2), (3, 2, None, "main", 3), (4, 2, None, "fork", 4), (5, 4, None, "fork", 5)]
    return spark.createDataFrame(rows, "id long, parent_id long, merge_parent_id long, branch string, created_at long")


def branches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in HEADS.items()], "name string, head long")


def place(key: str, other: str) -> tuple:
    """Coordinates from two keys."""
    return (
        ((F.col(other) * 7919) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0),
        ((F.col(key) * 104729) % 17000).cast("double") / F.lit(100.0) - F.lit(85.0),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of the orders: each is exploded into its versions, so that changeset_id is a column of data."""
    o = table(spark, sf_dir, "orders")
    lng, lat = place("o_orderkey", "o_custkey")
    text = lambda c: F.col(c).cast("string")
    props = F.to_json(F.struct(F.concat(F.lit("o"), text("o_orderkey")).alias("name"), F.col("o_orderstatus").alias("status"), text("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority")))
    base = o.select(F.col("o_orderkey").alias("feature_id"), props.alias("properties"), lng.alias("lng"), lat.alias("lat"))
    k, p, x, y, none = F.col("feature_id"), F.col("properties"), F.col("lng"), F.col("lat"), F.lit(None).cast("double")

    def part(n: int, op: str, p, x, y):
        return F.struct(F.lit(n).cast("long").alias("changeset_id"), F.lit(op).alias("operation"), p.alias("properties"), x.alias("lng"), y.alias("lat"))

    all_of = F.array(part(1, "insert", p, x, y), part(2, "update", p, x + 0.5, y), part(3, "delete", F.lit("{}"), none, none), part(4, "update", p, x, y + 0.25), part(5, "delete", F.lit("{}"), none, none))
    n = F.col("v.changeset_id")
    wanted = (n == 1) | ((n == 2) & (k % 5 == 0)) | ((n == 3) & (k % 7 == 0)) | ((n == 4) & (k % 3 == 0)) | ((n == 5) & (k % 11 == 0))
    rows = base.select("feature_id", F.explode(all_of).alias("v")).filter(wanted)
    return rows.select((k * 10 + n).alias("version_id"), "feature_id", "v.*", n.alias("created_at"))


#: The same projection in DuckDB.
ORACLE = """
base AS (SELECT o_orderkey AS feature_id,
  to_json({'name': concat('o', o_orderkey::VARCHAR), 'status': o_orderstatus, 'cust': o_custkey::VARCHAR, 'priority': o_orderpriority})::VARCHAR AS properties,
  ((o_custkey * 7919) % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS lng, ((o_orderkey * 104729) % 17000)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS lat FROM orders),
fv AS (SELECT feature_id * 10 + 1 AS version_id, feature_id, 1 AS changeset_id, 'insert' AS operation, properties, lng, lat FROM base
  UNION ALL SELECT feature_id * 10 + 2, feature_id, 2, 'update', properties, lng + 0.5::DOUBLE, lat FROM base WHERE feature_id % 5 = 0
  UNION ALL SELECT feature_id * 10 + 3, feature_id, 3, 'delete', '{}', NULL, NULL FROM base WHERE feature_id % 7 = 0
  UNION ALL SELECT feature_id * 10 + 4, feature_id, 4, 'update', properties, lng, lat + 0.25::DOUBLE FROM base WHERE feature_id % 3 = 0
  UNION ALL SELECT feature_id * 10 + 5, feature_id, 5, 'delete', '{}', NULL, NULL FROM base WHERE feature_id % 11 = 0),
cs AS (SELECT * FROM (VALUES (1, NULL, 'main', 1), (2, 1, 'main', 2), (3, 2, 'main', 3), (4, 2, 'fork', 4), (5, 4, 'fork', 5)) t(id, parent_id, branch, created_at))"""


def oracle_latest(head: int, name: str = "r") -> str:
    """CTEs: the parent chain of ``head`` and the latest versions along it."""
    return f"""c_{name}(id) AS (SELECT {head} UNION SELECT parent_id FROM cs JOIN c_{name} USING (id) WHERE parent_id IS NOT NULL),
{name} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY changeset_id DESC, version_id DESC) AS n FROM fv WHERE changeset_id IN (SELECT id FROM c_{name})) WHERE n = 1)"""
