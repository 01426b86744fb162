"""The changeset graph: closures, merge base, branch log.

Changesets form a graph of (id, parent_id, merge_parent_id, created_at). Reads follow parent_id alone;
diff, reachability and merge base follow both parents. A chain of parents is read by doubling: each
round appends what lies 2, 4, 8 ... steps above, so that a chain of n changesets takes log2(n) rounds
of two joins and not n. Merge parents start further chains, one pass for each depth of nested merges.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master (tests) may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronoterra-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of changesets (16 bytes each) up to which a chain is broadcast to the log; beyond it the join shuffles.
BROADCAST_CHAIN = 1_000_000


def _chains(changesets: DataFrame, heads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(start, id, depth) along parent_id from every id of ``heads``, itself at depth 0."""
    up = changesets.filter("parent_id is not null").select("id", F.col("parent_id").alias("far"))
    seen = checkpoint(heads.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("depth")).distinct())
    for k in range(max_rounds):  # seen holds depths under 2**k, up leads 2**k steps on
        more = checkpoint(seen.join(up, "id").select("start", F.col("far").alias("id"), (F.col("depth") + (1 << k)).alias("depth")))
        if more.isEmpty():
            return seen
        seen = seen.union(more)
        up = checkpoint(up.join(up.select(F.col("id").alias("far"), F.col("far").alias("farther")), "far").select("id", F.col("farther").alias("far")))
    raise RuntimeError("the changeset graph has a cycle")


def closure(changesets: DataFrame, heads: DataFrame, both: bool = False) -> DataFrame:
    """(start, id, depth): changesets reachable from each start of ``heads`` (column id).

    ``depth`` is the number of steps along parent_id; with ``both``, merge parents are followed too and
    depth is null.
    """
    seen = _chains(changesets, heads)
    if not both:
        return seen
    seen = seen.select("start", "id")
    merges = changesets.filter("merge_parent_id is not null").select("id", F.col("merge_parent_id").alias("other"))
    fresh = seen
    while True:
        aside = checkpoint(fresh.join(merges, "id").select("start", F.col("other").alias("id")).distinct().join(seen, ["start", "id"], "left_anti"))
        if aside.isEmpty():
            return seen.withColumn("depth", F.lit(None).cast("long"))
        chains = _chains(changesets, aside.select("id").distinct()).select(F.col("start").alias("via"), "id")
        reached = aside.withColumnRenamed("id", "via").join(chains, "via").select("start", "id").distinct()
        fresh = checkpoint(reached.join(seen, ["start", "id"], "left_anti"))
        seen = checkpoint(seen.union(fresh))


def ancestors(changesets: DataFrame, head: int, both: bool = True) -> DataFrame:
    start = changesets.sparkSession.range(1).select(F.lit(head).cast("long").alias("id"))
    return closure(changesets, start, both).select("id", "depth")


def small(chain: DataFrame) -> DataFrame:
    """A checkpointed chain, broadcast if its counted rows allow it."""
    return F.broadcast(chain) if chain.count() <= BROADCAST_CHAIN else chain


def is_reachable(changesets: DataFrame, head: int, target: int) -> bool:
    return not ancestors(changesets, head).filter(F.col("id") == target).isEmpty()


def reached(changesets: DataFrame, a: int, b: int) -> DataFrame:
    """(id, in_a, in_b): every changeset that either head reaches, from one closure of both."""
    heads = changesets.sparkSession.range(1).select(F.explode(F.array(F.lit(a).cast("long"), F.lit(b).cast("long"))).alias("id"))
    flag = lambda x: F.bool_or(F.col("start") == x)
    return closure(changesets, heads, both=True).groupBy("id").agg(flag(a).alias("in_a"), flag(b).alias("in_b"))


def merge_base(changesets: DataFrame, a: int, b: int) -> DataFrame:
    """The common ancestor with the greatest (created_at, id)."""
    common = reached(changesets, a, b).filter("in_a and in_b").select("id")
    return changesets.join(common, "id").orderBy(F.desc("created_at"), F.desc("id")).limit(1).select("id", "created_at")


def log(changesets: DataFrame, head: int, limit: int = 100) -> DataFrame:
    """Branch history, newest first."""
    return changesets.join(ancestors(changesets, head, both=False), "id").withColumn("depth", F.col("depth").cast("int")).orderBy("depth").limit(limit)
