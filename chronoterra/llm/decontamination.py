"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words: a pattern is a window of ten consecutive words of a benchmark item (an item of
fewer words is one window). Patterns of one length share a shift table keyed by blocks of up to three
words: while the block under the window's end ends no pattern, the search skips ahead by the block's
shift, up to the pattern length less the block length plus one. Where the shift is zero, the block's
bucket gives the patterns ending in it, and a comparison of all words confirms the occurrence.

Defined cases: null texts and texts without words have no hits; empty benchmark gives zero hits
throughout; items without words or without an id never count; two rows with one item_id are one item;
repeated documents keep their rows; very long texts are searched whole; extra columns, whatever their
names, don't matter to the counts and pass through the filter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 10
BLOCK = 3
#: UTF-8 bytes of benchmark text held by one search; a larger benchmark is searched in several passes.
PASS_BYTES = 2_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # applied after A-Z are lower-cased


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Searches for word windows; ``items`` are (item_id, UTF-8 text)."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW, shortest: int = 1):
        self.owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            if item is None or len(w) < shortest:
                continue
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                self.owners.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.tables = []
        for length in sorted({len(p) for p in self.owners}):
            block = min(BLOCK, length)
            shift: dict[tuple[bytes, ...], int] = {}
            ends: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
            for p in (p for p in self.owners if len(p) == length):
                for i in range(length - block + 1):
                    key, far = p[i : i + block], length - block - i
                    shift[key] = min(far, shift.get(key, far))
                ends.setdefault(p[length - block :], []).append(p)
            self.tables.append((length, block, shift, ends))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, end) of occurrences, in order of each length, and the items found."""
        spans, found, n = [], set(), len(w)
        for length, block, shift, ends in self.tables:
            most, end = length - block + 1, length
            while end <= n:
                key = tuple(w[end - block : end])
                s = shift.get(key, most)
                if s:
                    end += s
                    continue
                for p in ends[key]:
                    if all(map(bytes.__eq__, p, w[end - length : end])):
                        spans.append((end - length, end))
                        found |= self.owners[p]
                        break  # the windows are distinct, so no other one is equal here
                end += 1
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _passes(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[str, bytes | None]]]]:
    """The number of passes, and their items; one pass at a time is in the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // PASS_BYTES))

    def each() -> Iterator[list[tuple[str, bytes | None]]]:
        for i in range(n):
            part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) if n > 1 else items
            yield [(r.item_id, bytes(r.text) if r.text is not None else None) for r in part.toLocalIterator()]

    return n, each()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = 1) -> DataFrame:
    """One row per document: doc_id and the counts of _RESULT.

    One pass runs without any shuffle. More passes each report spans, which are merged per document row.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    n, passes = _passes(benchmark)
    if n > 1:
        return _merged(own, passes, window, shortest, kind)
    held = spark.sparkContext.broadcast(WuManber(next(passes), window, shortest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = held.value
        for b in batches:
            out = []
            for text in b.column(1):
                w = words(text.as_py())
                spans, found = engine.search(w)
                out.append((len(w), covered(spans), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(spans)))
            cols = [*zip(*out, strict=True)] or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return own.mapInArrow(run, f"doc_id {kind}, {_RESULT}")


def _merged(own: DataFrame, passes: Iterator[list[tuple[str, bytes | None]]], window: int, shortest: int, kind: str) -> DataFrame:
    spark = own.sparkSession
    keyed = own.withColumn("k", F.xxhash64("text"))
    parts = None
    for items in passes:
        held = spark.sparkContext.broadcast(WuManber(items, window, shortest))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(len(w), *held.value.search(w)) for w in (words(t.as_py()) for t in b.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([x[0] for x in found], pa.int64()), pa.array([[i for a, e in x[1] for i in (a, e)] for x in found], pa.list_(pa.int64())), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))],
                    ["doc_id", "k", "n_words", "spans", "items"],
                )

        one = keyed.mapInArrow(run, f"doc_id {kind}, k long, n_words long, spans array<long>, items array<string>")
        parts = one if parts is None else parts.union(one)

    @F.pandas_udf("long")
    def union_size(flat: pd.Series) -> pd.Series:
        return flat.map(lambda x: covered([*zip(x[::2].tolist(), x[1::2].tolist(), strict=True)]))

    rows = own.groupBy("doc_id", F.xxhash64("text").alias("k")).agg(F.count("*").alias("copies"))
    once = parts.groupBy("doc_id", "k").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = once.join(rows, once["doc_id"].eqNullSafe(rows["doc_id"]) & once["k"].eqNullSafe(rows["k"])).select(once["doc_id"], "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return both.select("doc_id", "n_words", union_size("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: Words that an item must have for the filter to act on it within a text; a lone common word is no leak.
FILTER_SHORTEST = 5


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = FILTER_SHORTEST) -> DataFrame:
    """Documents in which no window occurs; all columns stay. A null doc_id is judged by its row's text.

    An item of fewer words than ``shortest`` counts where it is the whole document.
    """
    _, passes = _passes(benchmark)
    clean = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    spark, schema = docs.sparkSession, clean.schema
    for items in passes:
        short = {tuple(w) for _, t in items if 0 < len(w := words(t)) < shortest}
        held = spark.sparkContext.broadcast((WuManber(items, window, shortest), short))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            engine, whole = held.value
            for b in (part for batch in batches for part in slices(batch)):
                keep = []
                for t in b.column(at).cast(pa.binary()):  # the words of one text at a time
                    w = words(t.as_py())
                    keep.append(not engine.search(w)[0] and tuple(w[:shortest]) not in whole)
                yield b.filter(pa.array(keep, pa.bool_()))

        clean = clean.mapInArrow(run, schema)
    return clean.toDF(*docs.columns)
