"""Mapbox vector tiles: one encoded feature per row, joined to a layer per tile.

``encoded_tiles`` are those of points without attributes. ``shape_tiles`` takes points, lines and
polygons with attributes:

1. A feature goes to the tiles that its box covers, is cut to each one with BUFFER units around it
   (polygons by functions/overlay), and is dropped where it doesn't reach the tile itself. Features
   are dealt to tasks before that, as the cutting takes far longer than the reading of a small file.
2. Keys and values are numbered per tile: values in PARTS parts by their hash, each after those before.
3. Features are encoded with their commands and tags, joined by (tile, part), and the parts by tile: a
   crowded tile's features are never one group, only their bytes are one row.

A tile of the same features has the same bytes on every run.
"""

from __future__ import annotations

import json
import math
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import overlay as kernel
from ..functions import shapes
from .grids import TILE_UNITS, tile_points, tile_position
from .history import checkpoint

BUFFER, PARTS = 64, 16
#: Decoded features of a tile that are handed on at once.
ROWS = 10_000
#: The types of features.
POINT, LINE, POLYGON = 1, 2, 3
_WORLD = 360.0  # the Web Mercator square's side in the units that shapes are cut in


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def feature_bytes(feature_id: int, x: int, y: int) -> bytes:
    """A point feature: id, the type point, one move to its place."""
    where = _varint(9) + _varint(_zigzag(x)) + _varint(_zigzag(y))
    return _bytes(2, _varint(8) + _varint(feature_id) + _varint(24) + _varint(1) + _bytes(4, where))


def layer_bytes(name: str, features: list[bytes], units: int) -> bytes:
    return _bytes(3, _bytes(1, name.encode()) + b"".join(features) + _varint(40) + _varint(units) + _varint(120) + _varint(2))


def encoded_tiles(rows: DataFrame, zoom: int, layer: str = "features", units: int = TILE_UNITS) -> DataFrame:
    """(tx, ty, n, mvt) of every tile of ``zoom`` that holds points."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [feature_bytes(*x) for x in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.binary())], ["feature_id", "tx", "ty", "one"])

    def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [layer_bytes(layer, parts, units) for parts in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], ["tx", "ty", "n", "mvt"])

    placed = tile_points(rows, zoom, units).select(F.col("feature_id").cast("long").alias("feature_id"), "tx", "ty", "px", "py")
    each = placed.mapInArrow(features, "feature_id long, tx long, ty long, one binary")
    grouped = each.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "one"))), lambda x: x["one"]).alias("parts"))
    return grouped.mapInArrow(layers, "tx long, ty long, n long, mvt binary")


def dataset_tiles(versions: DataFrame, changesets: DataFrame, branches: DataFrame, zoom: int) -> DataFrame:
    """(tx, ty, n) over all branches of the dataset: a feature counts once per branch that shows it."""
    from .grids import tile_counts
    from .snapshot import all_branches

    return tile_counts(all_branches(versions, changesets, branches), zoom)


# ---- shapes with attributes --------------------------------------------------------------------


def _on_tiles(rows: DataFrame, zoom: int, units: int, buffer: int) -> DataFrame:
    """Rows (feature_id, kind, shape, ...) on the Web Mercator square, and a box of each tile that their box covers.

    ``inside`` says that the row's box lies within the tile.
    """
    n = float(1 << zoom)

    def placed(p: Column) -> Column:
        x, y = tile_position(p["x"], p["y"], 0)
        return shapes.point(x * _WORLD, y * _WORLD)

    flat = F.transform("shape", lambda part: F.transform(part, lambda path: F.transform(path, placed)))
    box = shapes.bounds(F.flatten(F.flatten("shape")))
    own = rows.filter("size(shape) > 0").repartition("feature_id", "shape").withColumn("shape", flat).withColumn("box", box).filter("box.xmin is not null")
    last = F.lit((1 << zoom) - 1)
    at = lambda v: F.least(F.greatest(F.floor(v / _WORLD * n), F.lit(0)), last).cast("long")
    spread = own.withColumn("tx", F.explode(F.sequence(at(F.col("box.xmin")), at(F.col("box.xmax"))))).withColumn("ty", F.explode(F.sequence(at(F.col("box.ymin")), at(F.col("box.ymax")))))
    side = _WORLD / n

    def frame(more: float) -> Column:
        x0, y0 = (F.col(c) * side - more * side for c in ("tx", "ty"))
        x1, y1 = ((F.col(c) + 1) * side + more * side for c in ("tx", "ty"))
        return F.array(F.array(F.array(*[shapes.point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])))

    within = [(F.col(f"box.{v}min") >= F.col(c) * side) & (F.col(f"box.{v}max") <= (F.col(c) + 1) * side) for v, c in (("x", "tx"), ("y", "ty"))]
    return spread.withColumn("inside", within[0] & within[1]).withColumn("frame", frame(0.0)).withColumn("wide", frame(buffer / units)).drop("box")


def cut_lines(shape: list, box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """The runs of lines inside a box."""
    runs: list[list[tuple[float, float]]] = []
    for part in shape:
        for path in part:
            xy = np.array([(p["x"], p["y"]) for p in path])
            if len(xy) < 2:
                continue
            a, d = xy[:-1], np.diff(xy, axis=0)
            lo, hi = np.zeros(len(d)), np.ones(len(d))
            for i, (low, high) in enumerate(((box[0], box[2]), (box[1], box[3]))):
                still = d[:, i] == 0
                safe = np.where(still, 1.0, d[:, i])
                t = np.sort(np.stack([(low - a[:, i]) / safe, (high - a[:, i]) / safe]), axis=0)
                out = still & ((a[:, i] < low) | (a[:, i] > high))
                lo, hi = np.where(still, lo, np.maximum(lo, t[0])), np.where(out, -1.0, np.where(still, hi, np.minimum(hi, t[1])))
            open_ = False
            for i in np.flatnonzero(lo <= hi).tolist():
                first, end = a[i] + lo[i] * d[i], a[i] + hi[i] * d[i]
                if not (open_ and lo[i] == 0 and tuple(runs[-1][-1]) == tuple(first)):
                    runs.append([tuple(first)])
                runs[-1].append(tuple(end))
                open_ = hi[i] == 1
    return runs


def commands(kind: int, paths: list[list[tuple[int, int]]]) -> list[int]:
    """Moves, lines and ends of paths in tile units; what is a point or has no area in them is left out."""
    out, x, y = [], 0, 0

    def to(p: tuple[int, int]) -> list[int]:
        nonlocal x, y
        step = [_zigzag(p[0] - x), _zigzag(p[1] - y)]
        x, y = p
        return step

    if kind == POINT:
        return [len(paths) << 3 | 1, *[v for path in paths for v in to(path[0])]] if paths else []
    for path in paths:
        once = [p for i, p in enumerate(path) if not i or p != path[i - 1]]
        if kind == POLYGON:
            once = once[:-1] if once[0] == once[-1] else once
            if len(once) < 3 or not sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(once, once[1:] + once[:1], strict=True)):
                continue
        elif len(once) < 2:
            continue
        out += [9, *to(once[0]), len(once) - 1 << 3 | 2, *[v for p in once[1:] for v in to(p)]] + ([15] if kind == POLYGON else [])
    return out


def _unit_paths(shapes_: pa.Array, scale: float, x0: np.ndarray, y0: np.ndarray) -> Iterator[list[list[tuple[int, int]]]]:
    """The rings of each shape in whole units from (x0, y0)."""
    polygons = shapes_.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    of, per, size = (pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in (shapes_, polygons, rings))
    row = np.repeat(np.repeat(np.arange(len(of)), of), per)
    at = np.repeat(row, size)
    xy = [np.rint(points.field(k).to_numpy(zero_copy_only=False) * scale - low[at]).astype(np.int64).tolist() for k, low in enumerate((x0, y0))]
    corners, ends = list(zip(*xy, strict=True)), np.cumsum(size).tolist()
    paths = [corners[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    last = np.cumsum(np.bincount(row, minlength=len(of))).tolist()
    return (paths[a:b] for a, b in zip([0, *last], last, strict=False))


def _geometries(spread: DataFrame, zoom: int, units: int) -> DataFrame:
    """(feature_id, kind, tx, ty, attributes, commands) of every feature that reaches a tile."""
    scale = (1 << zoom) * units / _WORLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernel.in_parts(whole, 4):
                kinds, tx, ty = (b.column(i).to_pylist() for i in (1, 2, 3))
                polygon = pa.array([k == POLYGON for k in kinds])
                places = np.flatnonzero(polygon.to_numpy(zero_copy_only=False))
                made: list[list[int]] = [[] for _ in kinds]
                to_units = lambda i, x, y: (round(x * scale - tx[i] * units), round(y * scale - ty[i] * units))
                if len(places):
                    own = b.filter(polygon)
                    reaches = own.column(8).to_numpy(zero_copy_only=False).copy()
                    asked = np.flatnonzero(~reaches)
                    if len(asked):
                        part = own.take(pa.array(asked))
                        reaches[asked] = kernel.overlay(part.column(4), part.column(5), "intersection")[1]
                    cut, _ = kernel.overlay(own.column(4), own.column(6), "intersection")
                    for i, reached, paths in zip(places.tolist(), reaches.tolist(), _unit_paths(cut, scale, *(own.column(c).to_numpy() * units for c in (2, 3))), strict=True):
                        if reached:
                            made[i] = commands(POLYGON, paths)
                for i, k in enumerate(kinds):
                    if k == POLYGON:
                        continue
                    shape = b.column(4)[i].as_py()
                    frame, wide = ((r[0][0][0]["x"], r[0][0][0]["y"], r[0][0][2]["x"], r[0][0][2]["y"]) for r in (b.column(5)[i].as_py(), b.column(6)[i].as_py()))
                    if k == POINT:
                        inside = [(p["x"], p["y"]) for part in shape for path in part for p in path if frame[0] <= p["x"] < frame[2] and frame[1] <= p["y"] < frame[3]]
                        made[i] = commands(POINT, [[to_units(i, *p)] for p in inside])
                    elif cut_lines(shape, frame):
                        made[i] = commands(LINE, [[to_units(i, *p) for p in path] for path in cut_lines(shape, wide)])
                yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(7), pa.array(made, pa.list_(pa.int64()))], ["feature_id", "kind", "tx", "ty", "attributes", "commands"])

    own = spread.select(F.col("feature_id").cast("long").alias("feature_id"), F.col("kind").cast("int").alias("kind"), "tx", "ty", F.col("shape").cast(kernel.SHAPE_TYPE).alias("shape"), "frame", "wide", F.col("attributes").cast("map<string,string>").alias("attributes"), "inside")
    return own.mapInArrow(run, "feature_id long, kind int, tx long, ty long, attributes map<string,string>, commands array<long>").filter("size(commands) > 0")


def _numbered(tags: DataFrame, what: str, name: str) -> DataFrame:
    """(tx, ty, what, name): the distinct ones of each tile numbered from 0, in PARTS parts by hash."""
    own = tags.select("tx", "ty", what).distinct().withColumn("part", F.pmod(F.xxhash64(what), F.lit(PARTS)).cast("int"))
    counts = own.groupBy("tx", "ty", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tx", "ty").orderBy("part")) - F.col("n")
    local = F.row_number().over(Window.partitionBy("tx", "ty", "part").orderBy(what)) - 1
    return own.withColumn("local", local).join(counts.select("tx", "ty", "part", before.alias("before")), ["tx", "ty", "part"]).select("tx", "ty", what, (F.col("before") + F.col("local")).alias(name))


def value_bytes(raw: str) -> bytes:
    """A value from raw JSON: text, truth or number; whole numbers as such."""
    v = json.loads(raw)
    if isinstance(v, bool):
        return _varint(56) + _varint(int(v))
    if isinstance(v, int) and -(2**63) <= v < 2**63:
        return _varint(40) + _varint(v) if v >= 0 else _varint(48) + _varint(_zigzag(v))
    if isinstance(v, (int, float)):
        return _varint(25) + struct.pack("<d", v)
    return _bytes(1, (v if isinstance(v, str) else raw).encode())


def _packed(numbers: list[int]) -> bytes:
    return b"".join(map(_varint, numbers))


def shape_tiles(rows: DataFrame, zoom: int, layer: str = "features", units: int = TILE_UNITS, buffer: int = BUFFER) -> DataFrame:
    """(tx, ty, n, mvt) of every tile of ``zoom`` that a feature reaches.

    ``rows`` are (feature_id long, kind: POINT, LINE or POLYGON, shape, attributes map<string, string> of
    raw JSON). A shape is an array of parts, each an array of paths (of a polygon its rings). Attributes
    that are null or JSON null aren't encoded; objects and arrays are as text. Null and empty shapes are in no
    tile; a feature of several branches is there once for each.
    """
    spread = _on_tiles(rows.select("feature_id", "kind", "shape", "attributes"), zoom, units, buffer)
    drawn = checkpoint(_geometries(spread, zoom, units).withColumn("row", F.monotonically_increasing_id()))
    tags = drawn.select("row", "tx", "ty", F.explode("attributes").alias("key", "value")).filter("value is not null and value <> 'null'")
    keys, values = _numbered(tags, "key", "k"), _numbered(tags, "value", "v")
    tagged = tags.join(keys, ["tx", "ty", "key"]).join(values, ["tx", "ty", "value"])
    pairs = tagged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("tags"))
    whole = drawn.join(pairs, "row", "left").select("tx", "ty", "feature_id", "kind", "commands", F.flatten(F.transform("tags", lambda t: F.array(t["k"], t["v"]))).alias("tags"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, kind, steps, own in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                body = (_varint(8) + _varint(i) if i is not None and i >= 0 else b"") + (_bytes(2, _packed(own)) if own else b"")
                made.append(_bytes(2, body + _varint(24) + _varint(kind) + _bytes(4, _packed(steps))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], ["tx", "ty", "feature_id", "one"])

    def encoded(field: int, of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([_bytes(field, of(x)) for x in b.column(3).to_pylist()], pa.binary())], ["tx", "ty", "at", "one"])

        return run

    def joined(d: DataFrame, order: str, part: Column, name: str) -> DataFrame:
        """(tx, ty, number, bytes) of each tile: the bytes of a part in order, then the parts."""
        glued = lambda g: g.select("tx", "ty", "part", "n", F.transform("x", lambda x: x["one"]).alias("bytes")).mapInArrow(_glue, "tx long, ty long, part long, n long, one binary")
        sorted_ = lambda by: F.array_sort(F.collect_list(F.struct(by, "one"))).alias("x")
        parts = glued(d.groupBy("tx", "ty", part.alias("part")).agg(F.count("*").alias("n"), sorted_(order)))
        tiles = glued(parts.groupBy("tx", "ty").agg(F.lit(0).cast("long").alias("part"), F.sum("n").alias("n"), sorted_("part")))
        return tiles.select("tx", "ty", F.col("n").alias(f"{name}_n"), F.col("one").alias(name))

    by_place = F.floor(F.col("at") / 4096)
    body = joined(whole.mapInArrow(features, "tx long, ty long, feature_id long, one binary"), "feature_id", F.pmod(F.xxhash64("feature_id"), F.lit(PARTS)), "features")
    key_rows = keys.select("tx", "ty", F.col("k").cast("long").alias("at"), "key").mapInArrow(encoded(3, str.encode), "tx long, ty long, at long, one binary")
    value_rows = values.select("tx", "ty", F.col("v").cast("long").alias("at"), "value").mapInArrow(encoded(4, value_bytes), "tx long, ty long, at long, one binary")
    parts = body.join(joined(key_rows, "at", by_place, "keys"), ["tx", "ty"], "left").join(joined(value_rows, "at", by_place, "values"), ["tx", "ty"], "left")

    def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for f, k, v in zip(*(b.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                made.append(_bytes(3, _varint(120) + _varint(2) + _bytes(1, layer.encode()) + f + (k or b"") + (v or b"") + _varint(40) + _varint(units)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], ["tx", "ty", "n", "mvt"])

    return parts.select("tx", "ty", F.col("features_n").alias("n"), "features", "keys", "values").mapInArrow(layers, "tx long, ty long, n long, mvt binary")


def _glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([b"".join(x) for x in b.column(4).to_pylist()], pa.binary())], ["tx", "ty", "part", "n", "one"])


# ---- reading ---------------------------------------------------------------------------------


def _fields(data: bytes) -> dict[int, list]:
    """Values of a message by field number."""
    out, at = defaultdict(list), 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            out[field].append(number())
        elif kind == 1:
            out[field].append(struct.unpack_from("<d", data, at)[0])
            at += 8
        else:
            n = number()
            out[field].append(data[at : at + n])
            at += n
    return out


def _numbers(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    return out


def decode_tile(data: bytes) -> list[dict]:
    """The layers of a tile: name, units, and features (id, kind, paths in tile units, tags)."""
    unzig = lambda v: v >> 1 ^ -(v & 1)
    layers = []
    for raw in _fields(data)[3]:
        layer = _fields(raw)
        keys = [k.decode() for k in layer[3]]
        values = []
        for v in map(_fields, layer[4]):
            values.append(v[1][0].decode() if v[1] else bool(v[7][0]) if v[7] else v[5][0] if v[5] else unzig(v[6][0]) if v[6] else v[3][0])
        features = []
        for f in map(_fields, layer[2]):
            steps, at, x, y, paths = _numbers(f[4][0]), 0, 0, 0, []
            while at < len(steps):
                command, n = steps[at] & 7, steps[at] >> 3
                at += 1
                if command == 7:
                    paths[-1].append(paths[-1][0])
                    continue
                for _ in range(n):
                    x, y = x + unzig(steps[at]), y + unzig(steps[at + 1])
                    at += 2
                    if command == 1:
                        paths.append([])
                    paths[-1].append((x, y))
            tags = _numbers(f[2][0]) if f[2] else []
            features.append({"id": f[1][0] if f[1] else None, "kind": f[3][0], "paths": paths, "tags": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}})
        layers.append({"name": layer[1][0].decode(), "units": layer[5][0], "features": features})
    return layers


def decoded(tiles: DataFrame) -> DataFrame:
    """(tx, ty, feature_id, kind, area, length, tags) of every feature in encoded tiles, measured in tile units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string()))
        names = ["tx", "ty", "feature_id", "kind", "area", "length", "tags"]
        for b in batches:
            for tx, ty, data in zip(*(b.column(c) for c in (0, 1, 2)), strict=True):
                features = (f for layer in decode_tile(data.as_py()) for f in layer["features"])
                while part := list(islice(features, ROWS)):
                    rows = []
                    for f in part:
                        pairs = [(p, q) for path in f["paths"] for p, q in zip(path, path[1:], strict=False)]
                        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in pairs) / 2 if f["kind"] == POLYGON else 0.0
                        rows.append((tx.as_py(), ty.as_py(), f["id"], f["kind"], area, sum((math.hypot(p[0] - q[0], p[1] - q[1]) for p, q in pairs), 0.0), [(k, json.dumps(v)) for k, v in f["tags"].items()]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return tiles.select("tx", "ty", "mvt").mapInArrow(run, "tx long, ty long, feature_id long, kind int, area double, length double, tags map<string,string>")
