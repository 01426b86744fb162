"""Nearest neighbours of all features at once, and Voronoi cells.

The asked-for points are dealt to a quadtree that is as deep as they are dense: a node with over LEAF
points has children. All asking points descend together, a round per depth: each knows the cells that
may hold its k nearest, and how far its k-th can be at most (the cells that surely hold k points);
cells beyond that are dropped. In the end it meets the points of the few leaves that are left: both come
in packs, and a task hands on one row of an asking point and a leaf, with its k nearest there. No point
meets all others, however crowded a place is, and copies of one position are k rows at most.

A Voronoi cell is cut at the bisectors with the sites in and around its leaf. A cell is right when no site
is nearer to one of its corners than its own, which is known at once if these surroundings hold all places
that are. The few cells that reach further are asked about: that is a nearest-neighbour join, of corners
to sites, and sites that are found so cut the cell again, until none is.

Points without coordinates take no part. Ties go to the smaller id; copies of a position in a Voronoi
diagram share the cell of the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..functions import shapes
from .history import checkpoint

LEAF = 64
DEPTH, STEP = 26, 6
#: Nodes of the tree (about 40 bytes each) up to which it is broadcast to the asking points.
BROADCAST_NODES = 500_000
COPIES = 16
#: Asking points of a pack, and parts of a leaf's packs that meet its points in different tasks.
PACK, PARTS = 2048, 8
#: Sites in and around a leaf up to which its cells are cut by all of them.
HALO = 20_000


def _points(rows: DataFrame, name: str) -> DataFrame:
    own = rows.select(F.col(name).alias("id"), F.col("lng").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    return own.filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")


def _few_per_position(points: DataFrame, k: int) -> DataFrame:
    """At most k rows of each position, those of smallest id."""
    salted = Window.partitionBy("x", "y", F.pmod(F.xxhash64("id"), F.lit(COPIES))).orderBy("id")
    first = points.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k)
    return first.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).filter(F.col("n") <= k).drop("n")


class Tree:
    """Nodes (d, i, j, n, leaf) of a quadtree over points, and the leaf of every point."""

    def __init__(self, points: DataFrame):
        box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
        self.count = box[4]
        self.x0, self.y0, self.x1, self.y1 = (v or 0.0 for v in box[:4])
        self.side = max((box[2] or 0.0) - self.x0, (box[3] or 0.0) - self.y0, 1e-9) * (1 + 1e-9)
        at = lambda v, low: F.least(F.floor((v - low) / self.side * float(1 << DEPTH)).cast("long"), F.lit((1 << DEPTH) - 1))
        placed = points.withColumn("bi", at(F.col("x"), self.x0)).withColumn("bj", at(F.col("y"), self.y0))
        nodes, todo, start = [], placed, 0
        while True:
            end = min(start + STEP, DEPTH)
            level = checkpoint(todo.groupBy(*self._cell(end)).agg(F.count("*").alias("n")))
            heavy = checkpoint(level.filter(F.col("n") > LEAF).select("i", "j"))
            for d in range(end, start, -1):
                nodes.append(level.select(F.lit(d).alias("d"), "i", "j", "n"))
                level = level.groupBy(F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j")).agg(F.sum("n").alias("n"))
            if end == DEPTH or heavy.isEmpty():
                break
            todo = todo.withColumns({c: x for c, x in zip(("i", "j"), self._cell(end), strict=True)}).join(heavy, ["i", "j"], "left_semi").drop("i", "j")
            start = end
        every = reduce(DataFrame.union, nodes)
        leaf = (F.col("n") <= LEAF) | (F.col("d") == DEPTH)
        split = every.filter(~leaf).select((F.col("d") + 1).alias("d"), F.col("i").alias("pi"), F.col("j").alias("pj"))
        if self.count > LEAF:
            split = split.union(points.sparkSession.range(1).select(F.lit(1).alias("d"), F.lit(0).cast("long").alias("pi"), F.lit(0).cast("long").alias("pj")))
        owned = every.withColumn("pi", F.shiftright("i", 1)).withColumn("pj", F.shiftright("j", 1))
        # nodes whose parent has children: all others lie inside a leaf; each parent is one row of split, and a semi join would be one for each depth
        self.nodes = checkpoint(owned.join(split.hint("merge"), ["d", "pi", "pj"]).select("d", "i", "j", "n", leaf.alias("leaf")))
        self.small = self.nodes.count() <= BROADCAST_NODES
        self.placed = placed
        self.depths = depths = [r.d for r in self.nodes.filter("leaf").select("d").distinct().collect()]  # DEPTH numbers at most
        ways = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), *self._cell(d)) for d in depths] or [F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))]))
        dealt = placed.select("id", "x", "y", ways.alias("c")).select("id", "x", "y", "c.*")
        self.points = dealt.join(self._hint(self.nodes.filter("leaf").select("d", "i", "j", "n")), ["d", "i", "j"]) if depths else dealt.withColumn("n", F.lit(self.count))

    def _cell(self, d: int) -> list[Column]:
        return [F.shiftright(b, DEPTH - d).alias(c) for b, c in (("bi", "i"), ("bj", "j"))]

    def _hint(self, nodes: DataFrame) -> DataFrame:
        return F.broadcast(nodes) if self.small else nodes

    def children(self) -> DataFrame:
        """(d, i, j, children): a row for each inner node."""
        one = self.nodes.select((F.col("d") - 1).alias("d"), F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j"), F.struct("d", "i", "j", "n", "leaf").alias("child"))
        return self._hint(one.groupBy("d", "i", "j").agg(F.collect_list("child").alias("children")))

    def halos(self) -> DataFrame:
        """(d, i, j, id, x, y, own): for every leaf the points in it (own) and in the eight places of its size around it."""
        if not self.depths:
            return self.placed.select(F.lit(0).alias("d"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "id", "x", "y", F.lit(True).alias("own"))
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        ways = [F.struct(F.lit(d).alias("d"), *[(v + s).alias(c) for v, s, c in zip(self._cell(d), step, "ij", strict=True)], F.lit(step == (0, 0)).alias("own")) for d in self.depths for step in steps]
        near = self.placed.repartition("id").select("id", "x", "y", F.explode(F.array(*ways)).alias("c")).select("c.d", "c.i", "c.j", "id", "x", "y", "c.own")
        return near.join(self._hint(self.nodes.filter("leaf").select("d", "i", "j")), ["d", "i", "j"])

    def packs(self) -> DataFrame:
        """(d, i, j, salt, b, bx, by): the points of a leaf as arrays, by id, for each salt; of a leaf at DEPTH several packs."""
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LEAF)).alias("part")
        packed = self.points.groupBy("d", "i", "j", part).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("rows"))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("salt")
        return packed.select("d", "i", "j", salts, F.col("rows.id").alias("b"), F.col("rows.x").alias("bx"), F.col("rows.y").alias("by"))

    def reach(self, c: Column) -> tuple[Column, Column]:
        """(least, greatest) distance of (x, y) to the box of a node."""
        size = F.lit(self.side) / F.pow(F.lit(2.0), c["d"])
        parts = []
        for v, low, k in ((F.col("x"), self.x0, c["i"]), (F.col("y"), self.y0, c["j"])):
            a = F.lit(low) + k * size
            parts.append((F.greatest(a - v, v - a - size, F.lit(0.0)), F.greatest(F.abs(v - a), F.abs(v - a - size))))
        far = [F.sqrt(parts[0][i] * parts[0][i] + parts[1][i] * parts[1][i]) for i in (0, 1)]
        return far[0] * (1 - 1e-9), far[1] * (1 + 1e-9)


def _kept(cells: Column, k: int) -> Column:
    """Of cells (far, near, n, ...), those that may hold one of the k nearest."""
    ordered = F.array_sort(cells)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("far"))
    step = lambda s, c: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + c["n"]).alias("n"), c["far"].alias("far")))
    bound = F.aggregate(ordered, start, step, lambda s: F.when(s["n"] >= k, s["far"]).otherwise(F.lit(float("inf"))))
    return F.element_at(F.transform(F.array(bound), lambda b: F.filter(cells, lambda c: c["near"] <= b)), 1)


def _nearest_of(k: int):
    """Of packs (a, x, y) and (b, bx, by), the latter by id: (a, near) with the k nearest (d, b) of each a, the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, y, others, bx, by = (batch.column(c)[i].values for c in range(6))
                x, y, bx, by = (c.to_numpy() for c in (x, y, bx, by))
                n = min(k, len(bx))
                at, far = np.empty((len(x), n), np.int64), np.empty((len(x), n))
                for lo in range(0, len(x), 256):
                    dx, dy = x[lo : lo + 256, None] - bx, y[lo : lo + 256, None] - by
                    d = np.sqrt(dx * dx + dy * dy)
                    at[lo : lo + 256] = np.argsort(d, axis=1, kind="stable")[:, :n]
                    far[lo : lo + 256] = np.take_along_axis(d, at[lo : lo + 256], 1)
                near = pa.StructArray.from_arrays([pa.array(far.ravel()), others.take(pa.array(at.ravel()))], ["d", "b"])
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), near)], ["a", "near"])

    return run


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str = "feature_id", right_id: str = "feature_id", other: bool = False, tree: Tree | None = None) -> DataFrame:
    """(a, rank, b, d): the k right points nearest to each left one (fewer if there are no more), by planar distance, then id.

    With ``other``, a point isn't its own neighbour (by id). A ``tree`` over the right points may be given.
    """
    want = k + 1 if other else k
    tree = tree or Tree(_few_per_position(_points(right, right_id), want))
    asks = _points(left, left_id)
    if tree.count <= LEAF:
        met = asks.select("id", "x", "y", F.lit(0).alias("d"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    else:
        cell = lambda c: F.struct(tree.reach(c)[1].alias("far"), tree.reach(c)[0].alias("near"), c["n"].alias("n"), c["d"].alias("d"), c["i"].alias("i"), c["j"].alias("j"), c["leaf"].alias("leaf"))
        open_, done = asks.select("id", "x", "y", F.lit(0).alias("d"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.array().cast("array<struct<far:double,near:double,n:bigint,d:int,i:bigint,j:bigint,leaf:boolean>>").alias("rest")), None
        children = tree.children()
        for _ in range(DEPTH):
            # every asking point is one group: its new children and the leaves that it had, which only its first row carries
            new = open_.join(children, ["d", "i", "j"]).groupBy("id", "x", "y").agg(F.flatten(F.collect_list(F.transform("children", cell))).alias("new"), F.first("rest", ignorenulls=True).alias("rest"))
            state = checkpoint(new.select("id", "x", "y", _kept(F.concat("new", "rest"), want).alias("cells")))
            leaves, inner = F.filter("cells", lambda c: c["leaf"]), F.filter("cells", lambda c: ~c["leaf"])
            over = state.filter(F.size(inner) == 0).select("id", "x", "y", F.explode(leaves).alias("c"))
            done = over if done is None else done.union(over)
            rest = state.filter(F.size(inner) > 0)
            if rest.isEmpty():
                break
            open_ = rest.select("id", "x", "y", F.posexplode(inner).alias("p", "c"), leaves.alias("rest")).select("id", "x", "y", "c.d", "c.i", "c.j", F.when(F.col("p") == 0, F.col("rest")).alias("rest"))
        else:
            raise RuntimeError("the tree has no end")
        met = done.select("id", "x", "y", "c.d", "c.i", "c.j")
    counts = met.groupBy("d", "i", "j").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    dealt = met.join(tree._hint(counts), ["d", "i", "j"]).withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")))
    packs = dealt.groupBy("d", "i", "j", "pack").agg(F.collect_list(F.struct("id", "x", "y")).alias("rows")).withColumn("salt", F.pmod(F.col("pack"), F.lit(PARTS)))
    # a small file may hold many points: what the planner makes of its size must not send them all through the driver
    both = packs.join(tree.packs().hint("merge"), ["d", "i", "j", "salt"]).select(F.col("rows.id").alias("a"), F.col("rows.x").alias("x"), F.col("rows.y").alias("y"), "b", "bx", "by")
    one = StructType([StructField("d", DoubleType()), StructField("b", tree.points.schema["id"].dataType)])
    found = both.mapInArrow(_nearest_of(want), StructType([StructField("a", asks.schema["id"].dataType), StructField("near", ArrayType(one))]))
    near = found.groupBy("a").agg(F.flatten(F.collect_list("near")).alias("near"))
    others = F.filter("near", lambda c: c["b"] != F.col("a")) if other else F.col("near")
    ranked = near.select("a", F.posexplode(F.slice(F.sort_array(others), 1, k)).alias("n", "c"))
    return ranked.select("a", (F.col("n") + 1).alias("rank"), "c.b", "c.d")


def _cut_by(cell: Column, sites: Column, x: Column, y: Column) -> Column:
    """An open ring, cut at the bisectors of (x, y) and other sites."""

    def half(ring: Column, t: Column) -> Column:
        dx, dy = t["x"] - x, t["y"] - y
        a = shapes.point((t["x"] + x) / 2, (t["y"] + y) / 2)
        return shapes.half_plane(ring, a, shapes.point(a["x"] - dy, a["y"] + dx))

    return F.aggregate(sites, cell, half)


def _cut(ring: list[tuple[float, float]], x: float, y: float, ux: float, uy: float) -> list[tuple[float, float]]:
    """An open ring without what is nearer to (ux, uy) than to (x, y)."""
    dx, dy = ux - x, uy - y
    far = [(vx - x - dx / 2) * dx + (vy - y - dy / 2) * dy for vx, vy in ring]
    if max(far, default=0.0) <= 0:
        return ring
    out, (px, py), before = [], ring[-1], far[-1]
    for (vx, vy), after in zip(ring, far, strict=True):
        if (before < 0 < after) or (after < 0 < before):
            t = before / (before - after)
            out.append((px + t * (vx - px), py + t * (vy - py)))
        if after <= 0:
            out.append((vx, vy))
        (px, py), before = (vx, vy), after
    return out if len(out) > 2 else []


def _cells_of(tree: Tree, box: list[tuple[float, float]], start: int) -> Callable:
    """Of halos in the order of their leaves: (id, x, y, ring, right) for every site inside, by all sites of its halo."""
    x0, y0, x1, y1, side, most = tree.x0, tree.y0, tree.x1, tree.y1, tree.side, HALO

    def known(d: int, i: int, j: int) -> tuple[float, float, float, float]:
        """The box in which a halo holds all sites; nothing is beyond the tree's."""
        size, last, inf = side / 2**d, 2**d, math.inf
        slack = size * 1e-6
        return (-inf if i <= 1 else x0 + (i - 1) * size + slack, -inf if j <= 1 else y0 + (j - 1) * size + slack, inf if i + 2 >= last else x0 + (i + 2) * size - slack, inf if j + 2 >= last else y0 + (j + 2) * size - slack)

    def held(vx: float, vy: float, r: float, k: tuple[float, float, float, float]) -> bool:
        """Whether all sites within r of a place are inside the box k."""
        r = r * (1 + 1e-9) + 1e-9
        out_x, out_y = max(x0 - vx, vx - x1, 0.0), max(y0 - vy, vy - y1, 0.0)
        if out_x * out_x + out_y * out_y > r * r:
            return True
        wide, high = math.sqrt(max(r * r - out_y * out_y, 0.0)), math.sqrt(max(r * r - out_x * out_x, 0.0))
        return max(vx - wide, x0) >= k[0] and min(vx + wide, x1) <= k[2] and max(vy - high, y0) >= k[1] and min(vy + high, y1) <= k[3]

    def made(leaf: tuple[int, int, int], x: np.ndarray, y: np.ndarray, own: np.ndarray, whole: bool) -> Iterator[tuple[list, bool]]:
        k = known(*leaf)
        for at in np.flatnonzero(own).tolist():
            sx, sy = float(x[at]), float(y[at])
            d = (x - sx) ** 2 + (y - sy) ** 2
            order = np.argsort(d, kind="stable")
            order = order[order != at][: None if whole else start]
            ring = box
            reach = max(((vx - sx) ** 2 + (vy - sy) ** 2 for vx, vy in ring), default=0.0)
            for far, ux, uy in zip(d[order].tolist(), x[order].tolist(), y[order].tolist(), strict=True):
                if far > 4 * reach * (1 + 1e-9):
                    break  # no corner is nearer to it or to any that follows
                cut = _cut(ring, sx, sy, ux, uy)
                if cut is not ring:
                    ring = cut
                    reach = max(((vx - sx) ** 2 + (vy - sy) ** 2 for vx, vy in ring), default=0.0)
                if not ring:
                    break
            yield ring, whole and all(held(vx, vy, math.hypot(vx - sx, vy - sy), k) for vx, vy in ring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # of the last leaf so far: twice HALO rows of surroundings at most
        leaf, whole = None, True

        def told() -> pa.RecordBatch:
            b = pa.Table.from_batches(parts).combine_chunks()
            x, y, own = (b.column(c).to_numpy() for c in (4, 5, 6))
            cells = list(made(leaf, x, y, own, whole))
            at = pa.array(np.flatnonzero(own))
            size = np.cumsum([0, *[len(ring) for ring, _ in cells]]).astype(np.int32)
            corners = np.array([v for ring, _ in cells for v in ring], float).reshape(-1, 2)
            ring = pa.ListArray.from_arrays(pa.array(size), pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["x", "y"]))
            return pa.RecordBatch.from_arrays([*[b.column(c).take(at).combine_chunks() for c in (3, 4, 5)], ring, pa.array([right for _, right in cells], pa.bool_())], ["id", "x", "y", "ring", "right"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo].tolist())
                if key != leaf and parts:
                    yield told()
                    parts, whole = [], True
                leaf, part = key, batch.slice(lo, hi - lo)  # those inside come first
                if sum(p.num_rows for p in parts) + part.num_rows > most:  # the cells are asked about, whatever else is around
                    inside = part.column(6).to_numpy(zero_copy_only=False)
                    part, whole = part.filter(pa.array(inside | (np.arange(part.num_rows) < most))), False
                    if sum(p.num_rows for p in parts) > most:
                        part = part.filter(part.column(6))
                parts.append(part)
        if parts:
            yield told()

    return run


def voronoi(rows: DataFrame, envelope: tuple[float, float, float, float], start: int = 12, max_rounds: int = 60) -> DataFrame:
    """(feature_id, ring): the part of the envelope (xmin, ymin, xmax, ymax) nearer to each point than to any other.

    Points outside the envelope count; a cell that lies outside of it as a whole is absent. Where over HALO
    sites are around a leaf, its cells start from the ``start`` nearest of those that were read.
    """
    sites = checkpoint(_few_per_position(_points(rows, "feature_id"), 1))
    tree = Tree(sites)
    named = sites.select(F.col("id").alias("feature_id"), F.col("x").alias("lng"), F.col("y").alias("lat"))
    x0, y0, x1, y1 = envelope
    box = [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    place = sites.select(F.col("id").alias("b"), F.struct("x", "y").alias("t")).hint("merge")
    leaves = ["d", "i", "j"]
    ordered = tree.halos().repartition(*leaves).sortWithinPartitions(*leaves, F.col("own").desc())
    point = StructType([StructField(c, DoubleType()) for c in "xy"])
    schema = StructType([sites.schema["id"], *point.fields, StructField("ring", ArrayType(point)), StructField("right", BooleanType())])
    cells = checkpoint(ordered.mapInArrow(_cells_of(tree, box, start), schema).filter("size(ring) > 2"))
    done, open_ = cells.filter("right").select("id", "ring"), cells.filter("not right").drop("right")
    for _ in range(max_rounds):
        if open_.isEmpty():
            return done.select(F.col("id").alias("feature_id"), shapes.close_ring(F.col("ring")).alias("ring")).filter("size(ring) > 0")
        corners = open_.select("id", "x", "y", F.posexplode("ring").alias("n", "v"))
        own = F.sqrt(F.pow(F.col("v.x") - F.col("x"), 2) + F.pow(F.col("v.y") - F.col("y"), 2))
        named_corners = corners.select(F.struct("id", "n").alias("feature_id"), F.col("v.x").alias("lng"), F.col("v.y").alias("lat"), own.alias("own"))
        nearest = knn_join(named_corners, named, 1, tree=tree).join(named_corners.select(F.col("feature_id").alias("a"), "own").hint("merge"), "a")
        wrong = nearest.filter(F.col("d") < F.col("own") * (1 - 1e-12) - 1e-9).filter(F.col("a.id") != F.col("b"))
        more = wrong.join(place, "b").groupBy(F.col("a.id").alias("id")).agg(F.collect_set("t").alias("near"))
        asked = checkpoint(open_.join(more.hint("merge"), "id", "left"))
        done = done.union(asked.filter("near is null").select("id", "ring"))
        cut = asked.filter("near is not null").select("id", "x", "y", _cut_by(F.col("ring"), F.col("near"), F.col("x"), F.col("y")).alias("ring"))
        open_ = checkpoint(cut.filter("size(ring) > 2"))
    raise RuntimeError(f"cells did not settle in {max_rounds} rounds")


#: Degrees by which a cell is widened when points are dealt to cells: well over what rounding moves its sides.
SLACK = 1e-6


def cell_members(points: DataFrame, sites: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b): the site in whose Voronoi cell each point lies; on a shared side that of the nearest site, then of the smallest id.

    ``cells`` are those of ``sites``. A computed cell is never smaller than the true one but for rounding,
    so the widened cells of a point have the right one among them, and distances decide between these
    few. Cells are dealt to a grid as fine as they are many; a large cell uses a coarser level of it.
    """
    asks = _points(points, "feature_id").repartition("id")  # a small file is one task
    size = _points(sites, "feature_id").select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    box = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    # tables of sites and cells meet by shuffles: a small file of sites makes large tables, which mustn't go through the driver
    boxed = cells.withColumnRenamed("feature_id", "b").join(size.hint("merge"), "b").select("b", "bx", "by", "ring", *[f(v).alias(f"{n}{c}") for v, c in zip(box, "xy", strict=True) for f, n in ((F.array_min, "low_"), (F.array_max, "high_"))])
    wide = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) + 2 * SLACK
    leveled = checkpoint(boxed.withColumn("level", F.ceil(F.log2(wide)).cast("int")))  # a box covers two grid cells a side, or three
    levels = F.broadcast(leveled.select("level").distinct())  # a few dozen at most
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    spans = [F.sequence(at(F.col(f"low_{c}") - SLACK), at(F.col(f"high_{c}") + SLACK)) for c in "xy"]
    dealt = leveled.withColumn("i", F.explode(spans[0])).withColumn("j", F.explode(spans[1])).select("b", "bx", "by", "ring", "level", "i", "j")
    asked = asks.join(levels).select(F.col("id").alias("a"), "x", "y", "level", at(F.col("x")).alias("i"), at(F.col("y")).alias("j"))
    met = asked.join(dealt.hint("merge"), ["level", "i", "j"])
    steps = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    # left of every side, or beyond it by SLACK at most
    side = lambda s: (s["q"]["x"] - s["p"]["x"]) * (F.col("y") - s["p"]["y"]) - (s["q"]["y"] - s["p"]["y"]) * (F.col("x") - s["p"]["x"])
    long = lambda s: F.abs(s["q"]["x"] - s["p"]["x"]) + F.abs(s["q"]["y"] - s["p"]["y"])
    near = met.filter(F.forall(steps, lambda s: side(s) >= -SLACK * long(s)))
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    return near.groupBy("a").agg(F.min(F.struct(d.alias("d"), "b"))["b"].alias("b"))
