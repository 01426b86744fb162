"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends after a byte where the gear hash of the bytes before it has its mask bits at zero, so
the borders depend on the content alone and fall into step again after an insertion. Equal chunks
(by 128-bit digest) are one passage; the first occurrence, by doc_id and position, stays and the
others go. To leave chance repeats of short phrases alone, a run of neighbouring repeated chunks is
only removed if it holds ``min_run`` bytes.

Defined cases: null text stays null; a text shorter than the least chunk is one chunk; rows with one
doc_id and equal texts are one document (repeated rows all keep or lose the same passages); null
doc_id sorts before all ids; an empty table gives an empty table; columns other than the result's
pass by. Texts of any length are chunked whole; borders never split a UTF-8 character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAST = 16
MOST = 256
#: Five mask bits: a border every 32 bytes beyond the least size.
MASK = np.uint32(0xF8000000)
MIN_RUN = 80

#: 256 gear values from a rule: the first four bytes of the MD5 of the byte.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: h = (h << 1) + GEAR[byte], in 32 bits; built by doubling the window."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def chunks(text: bytes, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``text``; the last is its length."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    border = (gear(data) & MASK) == 0
    lead = np.ones(n, bool)  # a chunk may end before a byte that begins a character
    lead[:-1] = (data[1:] & 0xC0) != 0x80
    border &= lead
    ends, start = [], 0
    for e in (np.flatnonzero(border) + 1).tolist():
        while e - start > most:  # no border in reach
            cut = start + most
            while not lead[cut - 1]:
                cut -= 1
            ends.append(cut)
            start = cut
        if e - start >= least:
            ends.append(e)
            start = e
    while n - start > most:
        cut = start + most
        while not lead[cut - 1]:
            cut -= 1
        ends.append(cut)
        start = cut
    if start < n:
        ends.append(n)
    return ends


def chunk_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, k, a, b, d, e): a chunk, bytes a to b of the text; d and e are its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, at, to, dig = [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    a = 0
                    for b in chunks(t or b""):
                        row.append(i)
                        at.append(a)
                        to.append(b)
                        dig.append(xxhash.xxh128_digest(t[a:b]))
                        a = b
                idx, halves = pa.array(row, pa.int32()), np.frombuffer(b"".join(dig), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(idx), part.column(1).take(idx), pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    ["doc_id", "k", "a", "b", "d", "e"],
                )

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return keyed.mapInArrow(run, "doc_id long, k long, a int, b int, d long, e long")


def repeated_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, k, spans): the chunks of each document that stand earlier in the corpus, in order."""
    own = chunk_table(docs, text)
    at = F.struct("doc_id", "k", "a")
    first = own.groupBy("d", "e").agg(F.min(at).alias("first"), F.count("*").alias("times")).filter("times > 1").select("d", "e", "first")
    later = own.join(first, ["d", "e"]).filter(~at.eqNullSafe(F.col("first"))).select("doc_id", "k", "a", "b").distinct()
    return later.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def joined_runs(spans: list[dict[str, int]], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Neighbouring chunks (in order) as runs; those of ``min_run`` bytes at least."""
    runs: list[tuple[int, int]] = []
    for s in spans:
        if runs and runs[-1][1] == s["a"]:
            runs[-1] = runs[-1][0], s["b"]
        else:
            runs.append((s["a"], s["b"]))
    return [r for r in runs if r[1] - r[0] >= min_run]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def repeated_runs(docs: DataFrame, text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, k, runs): the byte spans of each document that stand earlier in the corpus, in order; no row without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = pa.array([[{"a": lo, "b": hi} for lo, hi in joined_runs(s.as_py(), min_run)] for s in b.column(2)], _RUNS)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), runs], ["doc_id", "k", "runs"])
            yield out.filter(pc.greater(pc.list_value_length(runs), 0))

    return repeated_chunks(docs, text).mapInArrow(run, "doc_id long, k long, runs array<struct<a:int,b:int>>")


def drop_repeats(docs: DataFrame, text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, text): the text without its repeated passages; removed lists byte spans."""
    again = repeated_runs(docs, text, min_run).select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out, gone, sizes = [], [], []
            for value, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                t, kept, at = value.as_py(), [], 0
                for r in runs or ():
                    kept.append(t[at : r["a"]])
                    at = r["b"]
                out.append(t if not runs else b"".join([*kept, t[at:]]))
                sizes.append(len(t or b""))
                gone.append(sum(r["b"] - r["a"] for r in runs or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), batch.column(2), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_bytes", "n_removed", "removed", "text"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    joined = keyed.join(again, keyed["doc_id"].eqNullSafe(again["r_id"]) & (keyed["k"] == again["r_k"]), "left")
    return joined.select("doc_id", "t", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, removed array<struct<a:int,b:int>>, text string")
