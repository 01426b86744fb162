"""Vector similarity: threshold search, pairs of a stated set or of a whole table, and ntile buckets around the mean vector."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import checkpoint

#: Vectors that a pass holds.
ASKED_AT_ONCE = 20_000
#: Bytes of a block of vectors, about, and vectors of a pack.
BLOCK, PACK = 16 << 20, 1024


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def similar_to(vectors: DataFrame, query: list[float], threshold: float = 0.8, limit: int = 10) -> DataFrame:
    """Above the threshold (strict), the first ``limit`` by id: the page is by id, not by score."""
    score = cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select("id", score.alias("score")).filter(F.col("score") > threshold).orderBy("id").limit(limit)


def mean_vector(vectors: DataFrame, size: int) -> list[float]:
    """Element-wise mean; one aggregate per component, one row returned."""
    row = vectors.agg(*[F.avg(F.element_at("vec", i + 1)).alias(f"m{i}") for i in range(size)]).first()
    return [row[i] for i in range(size)]


def _placed(vectors: DataFrame, size: int, k: int) -> DataFrame:
    """(id, at, bucket) by the cosine distance to the mean vector (ties by id), numbered by ranges: no task has all rows."""
    centre = mean_vector(vectors, size)
    d = vectors.select("id", (1 - cosine(F.col("vec"), F.array(*[F.lit(x) for x in centre]))).alias("d"))
    ranges = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(d.select("id", F.round("d", 9).alias("d")).repartitionByRange(ranges, "d", "id").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, longer = divmod(total, k)  # the first ``longer`` buckets have one more
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("d", "id")) - 1
    numbered = dealt.join(F.broadcast(before), "part").select("id", at.alias("at"))
    first = F.floor(F.col("at") / (least + 1))
    bucket = F.when(F.col("at") < longer * (least + 1), first).otherwise(F.floor((F.col("at") - longer) / max(least, 1))) + 1
    return numbered.select("id", "at", bucket.cast("int").alias("bucket"))


def ntile_buckets(vectors: DataFrame, size: int, k: int = 5) -> DataFrame:
    """Counts per ntile of the cosine distance to the mean vector."""
    return _placed(vectors, size, k).groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def bucket_members(vectors: DataFrame, size: int, k: int = 5, block: int = 1000) -> DataFrame:
    """(bucket, block, ids): the ids of each ntile, sorted, in arrays of ``block`` neighbours at most."""
    placed = _placed(vectors, size, k)
    return placed.groupBy("bucket", F.floor(F.col("at") / block).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def duplicates(vectors: DataFrame, asked: DataFrame, threshold: float = 0.95, block: int = 256) -> DataFrame:
    """(a, b, score): vectors more alike to an asked one than the threshold (strict), each unordered pair once.

    ``asked`` is a stated set of vectors. It is broadcast, so that each task multiplies its own rows with it,
    ``block`` rows at a time, and no vector is shuffled; more than ASKED_AT_ONCE of them are asked in further
    passes over the rows. What comes near the threshold is scored once more, component by component in their order.
    """
    passes = max(1, -(-asked.count() // ASKED_AT_ONCE))
    if passes > 1:
        part = lambda i: asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
        return reduce(DataFrame.union, [_met(vectors, part(i), threshold, block) for i in range(passes)]).groupBy("a", "b").agg(F.max("score").alias("score"))
    return _met(vectors, asked, threshold, block)


def _normed(vectors: DataFrame) -> DataFrame:
    """(id, v, n): vectors with their lengths; those of no length have no score."""
    return vectors.select("id", F.col("vec").cast("array<double>").alias("v"), F.sqrt(_dot(F.col("vec"), F.col("vec"))).alias("n")).filter("n > 0")


def _met(vectors: DataFrame, asked: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, score) of one pass."""
    of_length = defaultdict(list)  # ASKED_AT_ONCE at most; vectors of another length have no score
    for q in _normed(asked).collect():
        of_length[len(q.v)].append(q)
    held = vectors.sparkSession.sparkContext.broadcast({k: (np.array([q.id for q in qs], np.int64), np.array([q.v for q in qs]), np.array([q.n for q in qs])) for k, qs in of_length.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, norms, sizes = b.column(0).to_numpy(), b.column(2).to_numpy(), pc.list_value_length(b.column(1)).to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in held.value:
                    continue
                name, w, w_n = held.value[size]
                at = np.flatnonzero(sizes == size)
                v = b.column(1).take(pa.array(at)).flatten().to_numpy().reshape(-1, size)
                for lo in range(0, len(at), block):
                    rows = at[lo : lo + block]
                    far = (v[lo : lo + block] @ w.T) / (norms[rows, None] * w_n) <= threshold - 1e-9  # not where a score is no number
                    x, y = np.nonzero(~far & (ids[rows, None] != name))
                    dot = np.zeros(len(x))
                    for i in range(size):
                        dot += v[lo + x, i] * w[y, i]
                    score = dot / (norms[rows[x]] * w_n[y])
                    keep = ~(score <= threshold)
                    p, q = ids[rows[x[keep]]], name[y[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(score[keep])], ["a", "b", "score"])

    met = _normed(vectors).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "a long, b long, score double")
    return met.groupBy("a", "b").agg(F.max("score").alias("score"))


def _packs(dealt: DataFrame) -> DataFrame:
    """(block, size, ids, v, n): runs of PACK vectors of a block and length at most, as bytes."""
    schema = "block long, size int, ids binary, v binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            block, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(size, prepend=-1) != 0)).tolist()
            rows = [(i, min(i + PACK, end)) for at, end in zip(cuts, [*cuts[1:], b.num_rows], strict=True) for i in range(at, end, PACK)]
            cut = lambda c: pa.array([c.slice(i, j - i).to_numpy().tobytes() for i, j in rows], pa.binary())
            v = pa.array([b.column(3).slice(i, j - i).flatten().to_numpy().tobytes() for i, j in rows], pa.binary())
            first = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(first), b.column(1).take(first), cut(b.column(2)), v, cut(b.column(4))], ["block", "size", "ids", "v", "n"])

    return dealt.select("block", "size", "id", "v", "n").repartition("block").sortWithinPartitions("block", "size").mapInArrow(run, schema)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): all vectors more alike than the threshold (strict), each unordered pair once; of ids that repeat, the greatest score.

    Every vector meets every other: vectors are dealt to blocks by id, and every two blocks meet in a task,
    pack by pack, as a product of matrices. What comes near the threshold is scored once more, component by
    component in their order. No table is broadcast or sent to the driver; a task holds packs, not blocks, in Python.
    """
    d = vectors.withColumn("id", F.col("id").cast("long"))
    count, size = d.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-count * max(size, 1) * 8 // BLOCK), math.ceil(math.sqrt(2 * tasks)))
    packs = _packs(_normed(d).withColumn("size", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))))
    side = lambda name, i, j, low, high: packs.select("size", *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "v", "n")], F.col("block").alias(i), F.explode(F.sequence(low, high)).alias(j))
    zero, last = F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")
    both = side("a", "i", "j", F.col("block"), last).join(side("b", "j", "i", zero, F.col("block")).hint("merge"), ["i", "j", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same, width = batch.column(0)[r].as_py() == batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                (ids, v, n), (name, w, w_n) = ([np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in zip(range(lo, lo + 3), (np.int64, float, float), strict=True)] for lo in (3, 6))
                v, w = v.reshape(-1, width), w.reshape(-1, width)
                # lengths whose squares leave the range of numbers give no number here, and are scored below
                unit = [(x / np.where((k > 1e-140) & (k < 1e140), k, np.nan)[:, None]).astype(np.float32) for x, k in ((v, n), (w, w_n))]
                near = ~(unit[0] @ unit[1].T <= threshold - (width + 8) * 1.2e-7)  # what single precision is off by at most
                if same:  # both orders of a pair are there
                    near &= ids[:, None] < name
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                by, other = np.ascontiguousarray(v.T), np.ascontiguousarray(w.T)
                dot = np.zeros(len(x))
                for k in range(width):
                    dot += by[k][x] * other[k][y]
                score = dot / (n[x] * w_n[y])
                keep = ~(score <= threshold)
                p, q = ids[x[keep]], name[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(score[keep])], ["a", "b", "score"])

    met = both.select("i", "j", "size", *[f"{s}_{c}" for s in "ab" for c in ("ids", "v", "n")]).mapInArrow(run, "a long, b long, score double")
    if d.groupBy("id").count().filter("count > 1").isEmpty():
        return met
    return met.groupBy("a", "b").agg(F.max("score").alias("score"))
