"""Networks: trace, shortest path costs, service areas, components, isolated junctions.

Edges are (from_id, to_id, cost); a frontier DataFrame advances by joins, keeps the best cost per
junction and stops when nothing improves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import connected_components
from .history import checkpoint


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id", "cost").union(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "cost"))


def costs_from(edges: DataFrame, start: int, max_cost: float | None = None, directed: bool = False, max_steps: int = 10_000) -> DataFrame:
    """(id, cost, previous) of every junction reachable from ``start``, at least cost; ``max_cost`` bounds a service area."""
    links = checkpoint((edges if directed else both_ways(edges)).groupBy("from_id", "to_id").agg(F.min("cost").alias("cost")))
    none = F.lit(None).cast("long")
    best = checkpoint(edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0.0).alias("cost"), none.alias("previous")))
    changed = best
    for _ in range(max_steps):
        offers = changed.select(F.col("id").alias("from_id"), F.col("cost").alias("so_far")).join(links, "from_id").select(F.col("to_id").cast("long").alias("id"), (F.col("so_far") + F.col("cost")).alias("cost"), F.col("from_id").cast("long").alias("previous"))
        offers = offers if max_cost is None else offers.filter(F.col("cost") <= max_cost)
        fresh = offers.groupBy("id").agg(F.min(F.struct("cost", "previous")).alias("o"))
        old = best.select("id", F.col("cost").alias("old"))
        changed = checkpoint(fresh.join(old, "id", "left").filter("old is null or o.cost < old").select("id", "o.cost", "o.previous"))
        if changed.isEmpty():
            return best
        best = checkpoint(best.join(changed.select("id"), "id", "left_anti").union(changed))
    raise RuntimeError("costs did not settle")


def trace(edges: DataFrame, start: int, max_depth: int = 1000, direction: str = "downstream") -> DataFrame:
    """(id, depth): junctions within ``max_depth`` edges of ``start``, at least depth; upstream goes against the edges, both either way."""
    ways = {"downstream": edges.select("from_id", "to_id"), "upstream": edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), "both": both_ways(edges).select("from_id", "to_id")}
    links = checkpoint(ways[direction].distinct())
    seen = checkpoint(edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("id").alias("from_id")).join(links, "from_id").select(F.col("to_id").cast("long").alias("id")).distinct()
        frontier = checkpoint(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.union(frontier)) if depth % 8 == 0 else seen.union(frontier)
    return seen


def path(best: DataFrame, goal: int) -> list[int]:
    """Junctions from the start to ``goal``, one lookup per step of the path; empty if it isn't reached."""
    out, at = [], goal
    while at is not None:
        row = best.filter(F.col("id") == at).first()
        if row is None:
            return []
        out.append(at)
        at = row.previous
    return out[::-1]


def components(junctions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest junction id connected to each; isolated ones are their own."""
    links = edges.select(F.col("from_id").cast("long").alias("u"), F.col("to_id").cast("long").alias("v"))
    own = junctions.select(F.col("id").cast("long").alias("id"))
    return own.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def isolated(junctions: DataFrame, edges: DataFrame) -> DataFrame:
    return junctions.join(both_ways(edges).select(F.col("from_id").alias("id")).distinct(), "id", "left_anti")


def connectivity(junctions: DataFrame, edges: DataFrame) -> DataFrame:
    """(junctions, edges, components, isolated): one row of counts."""
    found = components(junctions, edges).agg(F.count("*").alias("junctions"), F.count_distinct("component").alias("components"))
    n, alone = edges.agg(F.count("*").alias("edges")), isolated(junctions, edges).agg(F.count("*").alias("isolated"))
    return found.crossJoin(n).crossJoin(alone).select("junctions", "edges", "components", "isolated")  # one row of each


def tour(edges: DataFrame, stops: list[int]) -> list[tuple[int, float]]:
    """(stop, cost so far) of a round trip: from the first stop always on to the nearest unseen one, and back.

    Costs between the listed stops come from Spark, one search per stop; the caller bounds the list. Fewer
    than two stops that can be reached give an empty tour.
    """
    edges = checkpoint(edges)  # every search reads them, so they are worked out once
    costs = {a: {r.id: r.cost for r in costs_from(edges, a).filter(F.col("id").isin(stops)).collect()} for a in stops}
    left = [b for b in dict.fromkeys(stops[1:]) if b != stops[0] and b in costs[stops[0]]] if stops else []
    if not left:
        return []
    out, at = [(stops[0], 0.0)], stops[0]
    while left:
        nearest = min(left, key=lambda b: (costs[at][b], b))
        out.append((nearest, out[-1][1] + costs[at][nearest]))
        left.remove(nearest)
        at = nearest
    return [*out, (stops[0], out[-1][1] + costs[at][stops[0]])]
