"""Overlay of shapes of any form: clip, intersect, difference, repair, and outlines of unions.

Two shapes of a row are overlaid by the kernel of functions/overlay, for all rows of an Arrow batch
together. A union of many features is a Spark job:

1. Shapes are cut to the cells of a grid. The pieces of a cell are united in their task, then by
   (key, cell, salt), then by (key, cell), so that a crowded cell is never gathered as it is.
2. What a cell's union has along the cell's sides cancels against the neighbour's by a running sum over
   the places on that side; what is left are borders.
3. Inside a cell, borders are joined to paths from side to side. Paths and side pieces are chained into
   rings by pointer doubling over (piece, next piece): the least piece of a ring names it.
4. Holes meet the outer rings whose box holds them by grid cell and go to the least that is around them.

Shapes are array<array<array<struct<x, y>>>> (see functions/overlay). Null and empty shapes have no
area; parts without area (shared corners or edges) aren't part of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..functions import overlay as kernel
from ..functions import shapes
from .history import checkpoint

SHAPE = kernel.SHAPE_TYPE
SALTS = 16
#: Cells over which a ring's box is spread in the join of holes with outer rings, at most.
BOX_CELLS = 4096
#: Features of a pack, features of a cell's right side that one task meets (a fuller cell is dealt to several), and the least area shared.
PACK, CROWD, LEAST_AREA = 512, 4096, 1e-9


def as_shape(ring: Column) -> Column:
    """A shape of one polygon with one ring."""
    return F.when(ring.isNotNull(), F.array(F.array(ring))).cast(SHAPE)


def shape_of_geojson(geojson: Column) -> Column:
    """The shape of a GeoJSON Polygon or MultiPolygon; null for other types."""
    position = "array<array<array<array<double>>>>"
    many = F.from_json(F.get_json_object(geojson, "$.coordinates"), position)
    one = F.array(F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>"))
    kind = F.get_json_object(geojson, "$.type")
    found = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one)
    return F.transform(found, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: shapes.point(p[0], p[1]))))


def _total(shape: Column, f) -> Column:
    """Sum of ``f`` over outer rings less that over holes."""
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    rings = lambda polygon: F.transform(polygon, lambda ring, i: F.when(i == 0, f(ring)).otherwise(-f(ring)))
    return add(F.transform(shape, lambda polygon: add(rings(polygon))))


def planar_area(shape: Column) -> Column:
    return _total(shape, lambda r: F.abs(shapes.twice_area(r)) / 2)


def sphere_area(shape: Column) -> Column:
    """Square metres on the sphere."""
    return _total(shape, shapes.sphere_area)


def shape_bounds(shape: Column) -> Column:
    """Box of the outer rings."""
    return shapes.bounds(F.flatten(F.transform(shape, lambda polygon: polygon[0])))


def contains_point(shape: Column, p: Column) -> Column:
    """Even-odd over all rings."""
    return F.aggregate(F.flatten(shape), F.lit(False), lambda s, ring: s != shapes.in_ring(p, ring))


def overlaid(rows: DataFrame, a: str, b: str | None, operation: str) -> DataFrame:
    """``rows`` with ``result`` (the operation on the shapes ``a`` and ``b``) and ``meets`` (whether they share a position)."""
    own = [(f"c{i}", c) for i, c in enumerate(rows.columns)]
    named = rows.select(*[F.col(f"`{c}`").alias(x) for x, c in own], F.col(a).cast(SHAPE).alias("a"), *([F.col(b).cast(SHAPE).alias("b")] if b else []))
    k = len(own)
    schema = StructType([*named.schema.fields[:k], StructField("result", named.schema["a"].dataType), StructField("meets", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in kernel.in_parts(whole, *range(k, k + 1 + bool(b))):
                shape, meets = kernel.overlay(part.column(k), part.column(k + 1) if b else None, operation)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], shape, pa.array(meets)], [f.name for f in schema.fields])

    return named.mapInArrow(run, schema).select(*[F.col(x).alias(c) for x, c in own], "result", "meets")


def _near_mask(rows: DataFrame, shape: str, mask: Column) -> DataFrame:
    """Rows whose box meets the mask's, with the mask beside them: no other row reaches Python."""
    own, other = shape_bounds(F.col(shape)), shape_bounds(mask)
    box = rows.withColumn("_box", own).withColumn("_mask_box", other)
    apart = [F.col(f"_box.{c}min") > F.col(f"_mask_box.{c}max") for c in "xy"] + [F.col(f"_mask_box.{c}min") > F.col(f"_box.{c}max") for c in "xy"]
    return box.filter(~(apart[0] | apart[1] | apart[2] | apart[3])).drop("_box", "_mask_box").withColumn("_mask", mask.cast(SHAPE))


def _masked(rows: DataFrame, mask: Column, shape: str, operation: str) -> DataFrame:
    return overlaid(_near_mask(rows, shape, mask), shape, "_mask", operation).filter("meets and size(result) > 0").drop("_mask", "meets")


def intersect(rows: DataFrame, mask: Column, shape: str = "shape") -> DataFrame:
    """All columns, ``shape`` cut to the mask; features without area in it are absent."""
    return _masked(rows, mask, shape, "intersection").withColumn(shape, F.col("result")).drop("result")


def clip(rows: DataFrame, mask: Column, shape: str = "shape") -> DataFrame:
    """(feature_id, shape), as intersect without other columns."""
    return intersect(rows.select("feature_id", shape), mask, shape)


def difference(rows: DataFrame, mask: Column, shape: str = "shape") -> DataFrame:
    """Features that meet the mask without what lies in it; covered and disjoint ones are absent."""
    return _masked(rows, mask, shape, "difference").withColumn(shape, F.col("result")).drop("result")


def overlay_pairs(left: DataFrame, right: DataFrame, cell: float, operation: str = "intersection") -> DataFrame:
    """(a, b, shape): the operation on every left and right feature (feature_id, shape) that share area.

    Both sides are dealt to the cells that their boxes cover; a pair is overlaid once, in the cell of the
    lower left corner of what the boxes share.
    """
    at = lambda v: F.floor(v / cell).cast("long")

    def dealt(d: DataFrame, n: str) -> DataFrame:
        box = d.select(F.col("feature_id").alias(n), F.col("shape").alias(f"{n}_shape"), shape_bounds(F.col("shape")).alias(f"{n}_box"))
        i, j = (F.sequence(at(F.col(f"{n}_box.{c}min")), at(F.col(f"{n}_box.{c}max"))) for c in "xy")
        return box.filter(f"{n}_box.xmin is not null").withColumn("i", F.explode(i)).withColumn("j", F.explode(j))

    # dealt by cell whatever the join: a small file is one task, which would overlay all pairs
    met = dealt(left, "a").join(dealt(right, "b").repartition("i", "j"), ["i", "j"])
    low = [F.greatest(F.col(f"a_box.{c}min"), F.col(f"b_box.{c}min")) for c in "xy"]
    high = [F.least(F.col(f"a_box.{c}max"), F.col(f"b_box.{c}max")) for c in "xy"]
    once = met.filter((F.col("i") == at(low[0])) & (F.col("j") == at(low[1])) & (low[0] < high[0]) & (low[1] < high[1])).select("a", "b", "a_shape", "b_shape")
    both = overlaid(once, "a_shape", "b_shape", "intersection").filter("size(result) > 0")
    if operation != "intersection":
        both = overlaid(both.drop("result", "meets"), "a_shape", "b_shape", operation)
    return both.select("a", "b", F.col("result").alias("shape"))


def _spans(rows: DataFrame, name: str) -> DataFrame:
    """(name, x0, y0, x1, y1, edges): of every shape with area its box and upright-free edges (px, py, qx, qy, ...), on the kernel's grid and turned as in ``repaired``."""
    own = rows.select(F.col("feature_id").alias(name), F.col("shape").cast(SHAPE).alias("shape")).repartition(name)  # a small file is one task
    box = [StructField(c, LongType()) for c in ("x0", "y0", "x1", "y1")]
    schema = StructType([own.schema[name], *box, StructField("edges", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in kernel.in_parts(whole, 1):
                e = kernel.edges_of(kernel.overlay(part.column(1), None, "own")[0])
                if not len(e):
                    continue
                first = np.flatnonzero(np.diff(e.own, prepend=-1))
                sides = [f.reduceat(c, first) for c, f in ((e.px, np.minimum), (e.py, np.minimum), (e.px, np.maximum), (e.py, np.maximum))]
                kept = e.take(e.px != e.qx)
                ends = np.searchsorted(kept.own, e.own[first], side="right")
                edges = pa.ListArray.from_arrays(pa.array(np.append(0, ends * 4).astype(np.int32)), pa.array(np.column_stack(kept.columns()[2:]).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(e.own[first])), *map(pa.array, sides), edges], schema.names)

    return own.mapInArrow(run, schema)


def _packed(dealt: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, name and the columns of _spans as arrays): runs of PACK features of one key at most, or of kernel.EDGES numbers of edges."""
    columns = [name, "x0", "y0", "x1", "y1", "edges"]
    ordered = dealt.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    k = len(keys)
    schema = StructType([*ordered.schema.fields[:k], *[StructField(f"{name}_{f.name}", ArrayType(f.dataType)) for f in ordered.schema.fields[k:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in batch.columns[:k]:
                new[1:] |= np.diff(c.to_numpy()) != 0
            run_start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            size = np.cumsum(pc.list_value_length(batch.column(k + 5)).to_numpy())
            full = size // kernel.EDGES
            new |= (np.arange(len(new)) - run_start) % PACK == 0
            new[1:] |= np.diff(full) != 0
            starts = np.flatnonzero(new)
            offsets = pa.array(np.append(starts, len(new)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(starts)) for c in batch.columns[:k]], *[pa.ListArray.from_arrays(offsets, c) for c in batch.columns[k:]]], schema.names)

    return ordered.mapInArrow(run, schema)


def overlay_areas(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(a, b, area): the planar area that every left and right feature (feature_id, shape) share, of LEAST_AREA at least.

    As overlay_pairs, for whom the area is enough: a shape is read once, not once for each pair, and pairs
    are found and summed up by packs of the features of a cell. A crowded cell is dealt to several tasks.
    """
    step = int(round(cell * kernel.GRID))

    def dealt(d: DataFrame, unit: int = step) -> DataFrame:
        i, j = (F.sequence(*[F.floor(F.col(f"{c}{n}") / unit).cast("long") for n in "01"]) for c in "xy")
        return d.withColumn("i", F.explode(i)).withColumn("j", F.explode(j))

    a, b = dealt(_spans(left, "a")), dealt(_spans(right, "b"))
    box = right.select(shape_bounds(F.col("shape")).alias("box")).filter("box.xmin is not null")
    rough = dealt(box.select(*[F.col(f"box.{c}{n}").alias(f"{c}{k}") for c in "xy" for k, n in enumerate(("min", "max"))]), cell)
    crowded = rough.groupBy("i", "j").agg(F.ceil(F.count("*") / CROWD).alias("salts")).filter("salts > 1")
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    spread = lambda d: d.join(F.broadcast(crowded), ["i", "j"], "left")  # noqa: E731 - a row for CROWD features
    b_salted = spread(b).withColumn("salt", F.pmod(F.xxhash64("b"), salts))
    a_packed = spread(_packed(a, "a", "i", "j")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    # no side goes through the driver, however small its file is: a pack is larger than what the planner guesses
    met = a_packed.join(_packed(b_salted, "b", "i", "j", "salt").hint("merge"), ["i", "j", "salt"])
    schema = StructType([left.select(F.col("feature_id").alias("a")).schema[0], right.select(F.col("feature_id").alias("b")).schema[0], StructField("area", DoubleType())])
    columns = [f"{n}_{c}" for n in "ab" for c in (n, "x0", "y0", "x1", "y1", "edges")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = (batch.column(c)[r].as_py() * step for c in (0, 1))
                one, two = ([batch.column(c)[r].values for c in range(lo, lo + 6)] for lo in (2, 8))
                (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = ([c.to_numpy() for c in side[1:5]] for side in (one, two))
                col = lambda v: v[:, None]
                # in the cell of the lower left corner of what the boxes share, which is not below either's
                meet = (col(ax0) < bx1) & (bx0 < col(ax1)) & (col(ay0) < by1) & (by0 < col(ay1)) & (col(ax0 >= i) | (bx0 >= i)) & (col(ay0 >= j) | (by0 >= j))
                p, q = np.nonzero(meet)
                area = kernel.shared_areas(one[5], two[5], p, q, i, j)
                keep = area >= LEAST_AREA
                yield pa.RecordBatch.from_arrays([one[0].take(pa.array(p[keep])), two[0].take(pa.array(q[keep])), pa.array(area[keep])], schema.names)

    return met.select("i", "j", *columns).mapInArrow(run, schema)


def repaired(rows: DataFrame, shape: str = "shape") -> DataFrame:
    """(feature_id, shape): every shape with simple, closed, properly turned rings and the same inside (even-odd).

    A self-crossing ring is cut at its crossings, and its odd faces become polygons; a shape without area has no polygon.
    """
    return overlaid(rows.select("feature_id", shape), shape, None, "own").select("feature_id", F.col("result").alias("shape"))


def polygons(rows: DataFrame) -> DataFrame:
    """(feature_id, part, polygon): one row for each polygon of a shape."""
    return rows.select("feature_id", F.posexplode("shape").alias("part", "polygon"))


# ---- unions ----------------------------------------------------------------------------------


def _united(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (keys, shape) with runs of equal keys united: within a task and in its order."""
    k = len(keys)
    ordered = rows.select(*keys, "shape")
    names = [*keys, "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last group so far, as one row
        for whole in batches:
            for part in kernel.in_parts(whole, k):
                if held is None:
                    both = part
                else:  # Spark names the elements of its arrays otherwise than the kernel: the values are what counts
                    both = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b if a.type == b.type else b.cast(a.type)]) for a, b in zip(held.columns, part.columns, strict=True)], names)
                row = np.zeros(both.num_rows, np.int64)
                for c in both.columns[:k]:
                    code = c.dictionary_encode().indices.fill_null(-1).to_numpy()
                    row[1:] |= code[1:] != code[:-1]
                group = np.cumsum(row)
                e = kernel.edges_of(both.column(k))
                e.own = group[e.own]
                result, _ = kernel.borders(kernel.noded(e), "own", winding=True)
                shape = kernel.rings_of(result).polygons(int(group[-1]) + 1 if len(group) else 0)
                first = np.flatnonzero(np.diff(group, prepend=-1))
                made = pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in both.columns[:k]], shape], names)
                if made.num_rows > 1:
                    yield made.slice(0, made.num_rows - 1)
                held = made.slice(max(0, made.num_rows - 1)) if made.num_rows else None
        if held is not None:
            yield held

    return ordered.mapInArrow(run, ordered.schema).select(*keys, "shape")


def cell_unions(rows: DataFrame, cell: float, shape: str = "shape") -> DataFrame:
    """(key, cx, cy, shape): what the rows of a key cover in each grid cell of side ``cell`` degrees."""
    at = lambda v: F.floor(v / cell).cast("long")
    box = shape_bounds(F.col("shape"))
    own = rows.select("key", F.col(shape).cast(SHAPE).alias("shape"), F.xxhash64(F.monotonically_increasing_id()).alias("n"))
    spread = own.withColumn("b", box).filter("b.xmin is not null").withColumn("cx", F.explode(F.sequence(at(F.col("b.xmin")), at(F.col("b.xmax"))))).withColumn("cy", F.explode(F.sequence(at(F.col("b.ymin")), at(F.col("b.ymax")))))
    x0, y0, x1, y1 = ((F.col(c) + d).cast("double") * F.lit(float(cell)) for c, d in (("cx", 0), ("cy", 0), ("cx", 1), ("cy", 1)))
    ring = F.array(*[shapes.point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    boxed = spread.select("key", "cx", "cy", "n", "shape", as_shape(ring).alias("box"))
    # oriented pieces, so that winding adds up
    pieces = overlaid(boxed, "shape", "box", "intersection").filter("size(result) > 0").select("key", "cx", "cy", F.pmod("n", F.lit(SALTS)).alias("salt"), F.col("result").alias("shape"))
    keys = ["key", "cx", "cy"]
    first = _united(pieces.sortWithinPartitions(*keys, "salt"), [*keys, "salt"])
    second = _united(first.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt"), [*keys, "salt"])
    return _united(second.repartition(*keys).sortWithinPartitions(*keys), keys)


def _pieces(cells: DataFrame, cell: float) -> DataFrame:
    """(key, kind, ...) of the unions of cells: whole rings, paths between sides, and pieces along sides."""
    step = int(round(cell * kernel.GRID))
    fields = "kind string, axis int, line long, sign int, sx long, sy long, ex long, ey long, out_x long, out_y long, in_x long, in_y long, points array<struct<x:double,y:double>>"
    names = [f.split()[0] for f in fields.split(", ")]
    key = StructType([cells.schema["key"]])
    schema = StructType([*key.fields, *cells.sparkSession.createDataFrame([], fields).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in kernel.in_parts(whole, 3):
                e = kernel.edges_of(part.column(3))
                if not len(e):
                    continue
                cx, cy = (part.column(i).to_numpy()[e.own] * step for i in (1, 2))
                side = np.zeros(len(e), np.int64)
                for n, on in enumerate((e.px == cx, e.px == cx + step)):
                    side[on & (e.qx == e.px)] = 1 + n
                for n, on in enumerate((e.py == cy, e.py == cy + step)):
                    side[on & (e.qy == e.py)] = 3 + n
                yield from _told(part.column(0), e, side, names, schema.names)

    return cells.select("key", "cx", "cy", "shape").mapInArrow(run, schema)


def _told(keys: pa.Array, e: kernel.Edges, side: np.ndarray, names: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces of the rings whose edges ``e`` has one after the other; side 0 is inside the cell."""
    starts = np.flatnonzero(np.diff(e.ring, prepend=-1)).tolist()
    rows: list[tuple] = []
    for a, b in zip(starts, [*starts[1:], len(e)], strict=True):
        inside = side[a:b] == 0
        if inside.all():
            rows.append((a, b, None))
            continue
        turn = int(np.flatnonzero(~inside)[0])
        at = np.concatenate([np.arange(a + turn, b), np.arange(a, a + turn)])
        run: list[int] = []
        for i in [*at.tolist(), -1]:
            if i >= 0 and side[i] == 0:
                run.append(i)
                continue
            if run:
                rows.append((0, 0, run))
                run = []
            if i >= 0:
                rows.append((i, -1, None))
    out = {c: [] for c in names}
    owner = []
    xy = lambda i: {"x": int(e.px[i]) / kernel.GRID, "y": int(e.py[i]) / kernel.GRID}

    def put(kind, first, last, points, axis=None, line=None, sign=None):
        owner.append(int(e.own[first]))
        values = (kind, axis, line, sign, e.px[first], e.py[first], e.qx[last], e.qy[last], e.qx[first] - e.px[first], e.qy[first] - e.py[first], e.px[last] - e.qx[last], e.py[last] - e.qy[last])
        for c, v in zip(names, [v if v is None or isinstance(v, str) else int(v) for v in values], strict=False):
            out[c].append(v)
        out["points"].append(points)

    for a, b, path in rows:
        if path is not None:
            put("path", path[0], path[-1], [xy(i) for i in path])
        elif b < 0:
            upright = side[a] <= 2
            put("side", a, a, None, 0 if upright else 1, e.px[a] if upright else e.py[a], 1 if (e.qy[a] > e.py[a] if upright else e.qx[a] > e.px[a]) else -1)
        else:
            put("ring", a, b - 1, [xy(i) for i in range(a, b)])
    kinds = {"kind": pa.string(), "axis": pa.int32(), "sign": pa.int32(), "points": pa.list_(kernel.POINT)}
    yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *[pa.array(out[c], kinds.get(c, pa.int64())) for c in names]], columns)


def _cancelled(sides: DataFrame, cell: float) -> DataFrame:
    """Pieces along cell sides that only one of the two cells has, as directed edges."""
    step = int(round(cell * kernel.GRID))
    along = lambda end: F.when(F.col("axis") == 0, F.col(f"{end}y")).otherwise(F.col(f"{end}x"))
    low, high = F.least(along("s"), along("e")), F.greatest(along("s"), along("e"))
    own = sides.select("key", "axis", "line", F.floor(low / step).alias("cell"), "sign", low.alias("low"), high.alias("high"))
    events = own.select("key", "axis", "line", "cell", F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("sign").alias("d")), F.struct(F.col("high").alias("at"), (-F.col("sign")).alias("d")))).alias("v"))
    sums = events.groupBy("key", "axis", "line", "cell", F.col("v.at").alias("at")).agg(F.sum("v.d").alias("d"))
    order = Window.partitionBy("key", "axis", "line", "cell").orderBy("at")
    net = sums.withColumn("net", F.sum("d").over(order)).withColumn("upto", F.lead("at").over(order)).filter("net <> 0 and upto is not null")
    a, b = F.when(F.col("net") > 0, F.col("at")).otherwise(F.col("upto")), F.when(F.col("net") > 0, F.col("upto")).otherwise(F.col("at"))
    place = lambda v, axis: F.when(F.col("axis") == axis, F.col("line")).otherwise(v)
    ends = net.select("key", place(a, 0).alias("sx"), place(a, 1).alias("sy"), place(b, 0).alias("ex"), place(b, 1).alias("ey"))
    grid = float(kernel.GRID)
    return ends.select(
        "*", (F.col("ex") - F.col("sx")).alias("out_x"), (F.col("ey") - F.col("sy")).alias("out_y"), (F.col("sx") - F.col("ex")).alias("in_x"), (F.col("sy") - F.col("ey")).alias("in_y"),
        F.array(shapes.point(F.col("sx") / grid, F.col("sy") / grid)).alias("points"),
    )


def chained(pieces: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(key, ring): closed rings of the directed pieces (key, sx, sy, ex, ey, out_x, out_y, in_x, in_y, points).

    ``points`` are a piece's positions without its end. Where several pieces leave a node, one that
    arrives goes on with the first one clockwise. All rings are followed at once: after k rounds a piece
    knows the least id among the next 2**k of its ring and how far on it is.
    """
    own = checkpoint(pieces.withColumn("id", F.monotonically_increasing_id()))
    ends = own.select("id", "key", F.col("ex").alias("x"), F.col("ey").alias("y"), "in_x", "in_y")
    starts = own.select(F.col("id").alias("next"), F.col("key").alias("key2"), F.col("sx").alias("x"), F.col("sy").alias("y"), "out_x", "out_y")
    met = ends.join(starts, ["x", "y"]).filter(F.col("key").eqNullSafe(F.col("key2")))
    turn = F.atan2(F.col("in_y").cast("double"), F.col("in_x").cast("double")) - F.atan2(F.col("out_y").cast("double"), F.col("out_x").cast("double"))
    clockwise = F.when(turn <= 1e-15, turn + 2 * np.pi).otherwise(turn)
    state = checkpoint(met.groupBy("id").agg(F.min_by("next", clockwise).alias("jump")).select("id", "jump", F.col("id").alias("ring"), F.lit(0).cast("long").alias("far")))
    before = None
    for k in range(max_rounds):
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("ring").alias("ring2"), F.col("far").alias("far2"))
        less = F.col("ring2") < F.col("ring")
        state = checkpoint(state.join(ahead, "jump").select(
            "id", F.col("jump2").alias("jump"), F.when(less, F.col("ring2")).otherwise(F.col("ring")).alias("ring"),
            F.when(less, F.col("far2") + (1 << k)).otherwise(F.col("far")).alias("far"),
        ))
        mark = state.agg(F.sum(F.col("ring").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"rings did not close in {max_rounds} rounds")
    placed = own.join(state.select("id", "ring", "far"), "id")
    whole = placed.groupBy("ring").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("far"), "points"))).alias("p"))
    # the head has far 0 and comes last; from it on, the others follow in falling distance
    path = F.flatten(F.transform("p", lambda x: x["points"]))
    return whole.select("key", F.concat(path, F.slice(path, 1, 1)).alias("ring"))


def outlines(rows: DataFrame, cell: float, shape: str = "shape") -> DataFrame:
    """(key, polygon): the polygons that the rows (key, shape) of each key cover together, holes included."""
    pieces = checkpoint(_pieces(cell_unions(rows, cell, shape), cell))
    ends = ["key", "sx", "sy", "ex", "ey", "out_x", "out_y", "in_x", "in_y", "points"]
    inner = pieces.filter("kind = 'path'").select(*ends)
    sides = _cancelled(pieces.filter("kind = 'side'"), cell).select(*ends)
    alone = pieces.filter("kind = 'ring'").select("key", F.concat("points", F.slice("points", 1, 1)).alias("ring"))
    return assembled(_simple(chained(inner.union(sides)).unionByName(alone)), cell)


def _simple(rings: DataFrame) -> DataFrame:
    """(key, ring): rings that meet themselves at a corner, as the simple rings that they are made of."""
    schema = StructType([rings.schema["key"], StructField("rings", ArrayType(rings.schema["ring"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in kernel.in_parts(whole, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), kernel.rings_of(kernel.edges_of(part.column(1))).loose(part.num_rows)], ["key", "rings"])

    made = rings.select("key", as_shape(F.col("ring")).alias("shape")).mapInArrow(run, schema)
    return made.select("key", F.explode("rings").alias("ring"))


def assembled(rings: DataFrame, cell: float) -> DataFrame:
    """(key, polygon) of simple rings: counter-clockwise ones are outer, each other one is a hole of the least outer ring of its key that is around it."""
    named = checkpoint(rings.select(F.monotonically_increasing_id().alias("id"), "key", "ring", shapes.twice_area(F.col("ring")).alias("area")))
    outer, hole = named.filter("area > 0"), named.filter("area < 0")
    # a box of many cells uses a coarser grid of its own: the level is the power of two that leaves BOX_CELLS or fewer
    box = shapes.bounds(F.col("ring"))
    sized = outer.withColumn("b", box)
    wide = F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")) / cell
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide, F.lit(1.0)) / (BOX_CELLS**0.5)))).cast("int")
    leveled = checkpoint(sized.withColumn("level", level))
    at = lambda v: F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    cells = leveled.withColumn("i", F.explode(F.sequence(at(F.col("b.xmin")), at(F.col("b.xmax"))))).withColumn("j", F.explode(F.sequence(at(F.col("b.ymin")), at(F.col("b.ymax")))))
    levels = leveled.select("level").distinct()
    # a position inside the first edge: no other ring comes there, but at single corners
    middle = shapes.point(*[F.col("ring")[0][c] * 0.623 + F.col("ring")[1][c] * 0.377 for c in "xy"])
    asked = hole.select(F.col("id").alias("hole"), F.col("key").alias("hole_key"), F.abs("area").alias("hole_area"), F.col("ring").alias("hole_ring"), middle.alias("p")).join(F.broadcast(levels))
    asked = asked.withColumn("i", at(F.col("p.x"))).withColumn("j", at(F.col("p.y")))
    met = asked.join(cells, ["level", "i", "j"]).filter(F.col("key").eqNullSafe(F.col("hole_key")) & (F.col("area") > F.col("hole_area")))
    around = met.filter(shapes.in_ring(F.col("p"), F.col("ring"))).groupBy("hole").agg(F.min_by("id", F.struct("area", "id")).alias("id"))
    holes = around.join(hole.select(F.col("id").alias("hole"), F.col("ring").alias("hole_ring")), "hole").groupBy("id").agg(F.collect_list("hole_ring").alias("holes"))
    joined = outer.join(holes, "id", "left")
    return joined.select("key", F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("polygon"))


def covered_area(rows: DataFrame, cell: float, shape: str = "shape") -> DataFrame:
    """(key, area, planar): what the rows of each key cover together, in square metres on the sphere and square degrees."""
    own = cell_unions(rows, cell, shape).select("key", sphere_area(F.col("shape")).alias("area"), planar_area(F.col("shape")).alias("planar"))
    return own.groupBy("key").agg(F.sum("area").alias("area"), F.sum("planar").alias("planar"))
