"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import checkpoint

#: Links of one node from which its rows are not sent to one task. A graph that has no more is one partition.
HEAVY = 50_000


def _with_least(both: DataFrame, links: int) -> DataFrame:
    """``both`` (u, v) with m, the least v of each u. Nodes with over HEAVY links (so few, as they
    number the links / HEAVY at most) meet their rows by a broadcast, the others by a shuffle on u."""
    if links <= HEAVY:  # then no node has more
        return both.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hot = least.filter(F.col("n") > HEAVY).select("u", "m")
    rest = both.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.filter(F.col("n") <= HEAVY).select("u", "m"), "u")
    return both.join(F.broadcast(hot), "u").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v); root is the smallest node reachable.

    Alternates large-star and small-star steps: each is one grouped minimum and one join, so no
    neighbourhood is ever gathered in one place. Rounds make no more links, so a graph of HEAVY at most
    (counted from both ends) stays in one partition, where no step shuffles: else each round has ten
    tasks for each partition of a shuffle, however few the links. Self links are ignored; no links give no rows.
    """
    e = checkpoint(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    )
    mark = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = 2 * before[0]
        e = e.coalesce(1) if links <= HEAVY else e  # a checkpoint doesn't tell that it is one partition
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        large = _with_least(both, links).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = large if links <= HEAVY else checkpoint(large)
        # every remaining link runs from the larger u to the smaller v
        small = _with_least(large, links).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        e = checkpoint(small.select("x.u", "x.v").filter("u != v").distinct())
        after = mark(e)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
