"""Exact top-k inner-product search with three-phase uniform threshold.

A vector's dimensions are cut into lists; a score is the sum of its partial scores over the lists. The
rows stay where they are: every task reads its own against a bounded set of queries that it holds.

1. For each query, the best entries of every list are resolved and a task keeps the k best scores it
   has met. The k-th best of all tasks is reached by k rows at least: a safe cutoff.
2. The cutoff t goes back to the tasks. With each list's partial scores counted from its least one, a
   row that reaches t has t / lists or more in some list. Entries that do, and whose bound (known
   parts plus t / lists for every other list) reaches t, are sufficient.
3. Their scores are resolved exactly; a task hands on its k best at or above t.

The k best of all tasks are the exact answer; ties go to the smaller vec_id. Queries beyond
QUERIES_AT_ONCE are asked in further passes over the rows; no vector is shuffled.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
without id; shorter vectors, empty ones too, count as padded with zeros; of differing vectors of one
query id the least (as an array) is asked, once; repeated candidate rows are candidates each; a query
is never its own candidate (by id); fewer than k candidates are all returned; extra columns, whatever
their names, don't matter; empty tables give an empty table. Scores are exact: products that float64
could round are computed with integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
LISTS = 4
#: Queries that a pass holds: a bound on what is collected and broadcast.
QUERIES_AT_ONCE = 20_000
#: Rows and queries scored at once: bounds a task's matrices.
ROWS, STEP = 4096, 128
SCALE = 256
_NONE = np.iinfo(np.int64).min


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows padded with zeros to ``width`` or, if that is more, to the longest one."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    width = max(width, int(at.max(initial=0)))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < at[:, None]] = flat
    return out


def _parts(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Partial scores, rows x queries, of each list."""
    width = max(x.shape[1], q.shape[1])
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width)
    kind = np.float64 if most * LISTS * 2 < 2**53 else np.int64
    shared = min(x.shape[1], q.shape[1])  # what the shorter side lacks is zero
    return [x[:, c].astype(kind) @ q[:, c].T.astype(kind) for c in np.array_split(np.arange(shared), LISTS)]


class Queries:
    """A bounded set of queries, with their cutoffs from the second phase on."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, cutoff: np.ndarray | None = None):
        self.ids, self.q, self.cutoff = ids, q, cutoff

    def first_phase(self, ids: np.ndarray, x: np.ndarray, best: np.ndarray) -> None:
        """Raises ``best`` (k x queries) by the scores of the rows that head some list."""
        k = len(best)
        for i in range(0, len(self.ids), STEP):
            parts = _parts(x, self.q[i : i + STEP])
            cols = np.arange(parts[0].shape[1])
            most = min(k + 1, len(ids))  # one more, as the query itself may be among them
            heads = np.sort(np.concatenate([np.argpartition(-p, most - 1, axis=0)[:most] for p in parts]), axis=0)
            scores = sum(p[heads, cols] for p in parts).astype(np.int64)
            scores[1:][heads[1:] == heads[:-1]] = _NONE  # in several lists, but one row
            scores[ids[heads] == self.ids[None, i : i + STEP]] = _NONE
            both = np.concatenate([best[:, i : i + STEP], scores])
            best[:, i : i + STEP] = np.partition(both, len(both) - k, axis=0)[-k:]

    def last_phases(self, ids: np.ndarray, x: np.ndarray, k: int, found: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Puts the k best rows at or above the cutoff of every query, by its place, into ``found``."""
        for i in range(0, len(self.ids), STEP):
            parts, cut = _parts(x, self.q[i : i + STEP]), self.cutoff[i : i + STEP]
            known = cut != _NONE
            low = [p.min(axis=0) for p in parts]
            t = np.where(known, cut, 0) - sum(low)  # the cutoff, counted from the least partial scores
            bound, seen = np.zeros_like(parts[0]), np.zeros(parts[0].shape, bool)
            for p, least in zip(parts, low, strict=True):  # times LISTS, so that t / LISTS stays whole
                high = (p - least) * LISTS >= t
                bound += np.where(high, (p - least) * LISTS, t)
                seen |= high
            enough = ((seen & (bound >= t * LISTS)) | ~known) & (ids[:, None] != self.ids[None, i : i + STEP])
            for j in np.flatnonzero(enough.any(axis=0)).tolist():
                at = np.flatnonzero(enough[:, j])
                score = sum(p[at, j] for p in parts).astype(np.int64)
                keep = score >= cut[j]
                old = found.get(i + j, (np.array([], np.int64),) * 2)
                rows, scores = np.concatenate([old[0], ids[at][keep]]), np.concatenate([old[1], score[keep]])
                top = np.lexsort((rows, -scores))[:k]
                found[i + j] = rows[top], scores[top]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            b = whole.slice(lo, ROWS)
            yield b.column(0).to_numpy(), _matrix(b.column(1))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of ``vectors`` for every row of ``queries``."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        d = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).filter("id is not null and e is not null")
        good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return d.filter(good).select("id", F.transform("e", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))

    rows, asked = whole(vectors), whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    passes = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"))

    def one_pass(part: DataFrame) -> DataFrame:
        held = part.orderBy("id").toArrow().combine_chunks()  # about QUERIES_AT_ONCE rows
        lists = held.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ids, q = held.column("id").to_numpy(), _matrix(lists)
        first = spark.sparkContext.broadcast(Queries(ids, q))

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((k, len(first.value.ids)), _NONE)
            for row_ids, x in _blocks(batches):
                first.value.first_phase(row_ids, x, best)
            at = np.nonzero(best != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(first.value.ids[at[1]]), pa.array(best[at])], ["query_id", "score"])

        kth = rows.mapInArrow(scores, "query_id long, score long").withColumn("n", F.row_number().over(best_first)).filter(F.col("n") == k)
        known = kth.select("query_id", "score").toArrow()  # one number for each held query
        cutoff = np.full(len(ids), _NONE)
        cutoff[np.searchsorted(ids, known.column("query_id").to_numpy())] = known.column("score").to_numpy()
        second = spark.sparkContext.broadcast(Queries(ids, q, cutoff))

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for row_ids, x in _blocks(batches):
                second.value.last_phases(row_ids, x, k, found)
            cols = [np.concatenate(c) if found else np.array([], np.int64) for c in ([np.full(len(r), second.value.ids[j]) for j, (r, _) in found.items()], [r for r, _ in found.values()], [s for _, s in found.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(tops, "query_id long, vec_id long, score long")

    parts = [one_pass(asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i) if passes > 1 else asked) for i in range(passes)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
