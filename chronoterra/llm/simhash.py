"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits differ in
at most two bytes, so they share six positional bytes at least: that is the guaranteed minimum.

* Index: the eight positions are four blocks of two. Two differing bytes leave two blocks whole, so a
  fingerprint is entered under each of the six pairs of blocks, with the four bytes there as the key:
  six entries and lists of about 1 / 2**32 of the corpus (single bytes would make lists of 1/256 of it).
* Tally: two fingerprints that meet in a list share four positional bytes at least; the tally counts
  all that they share, and pairs that reach the guaranteed minimum of six are kept.
* Verify: the differing bits of a kept pair are counted.

Copies are one entry: the index holds distinct fingerprints. A long list (a family of near copies) is
not expanded into its pairs: members one bit away from a common value are within two bits of each
other and are linked to the smallest of them, which gives the same components.

``keep_one`` takes another measure, five-word shingles that agree to 0.8, by the same index, tally and
verification over longer fingerprints (see near_copies).

Defined cases: null or blank text has the fingerprint zero and is linked like any other; fewer words
than ``k`` make one shingle; very long texts are read whole, in bounded memory; equal texts always
share a group; rows with a null doc_id are fingerprinted and grouped but never name the group unless
all its rows are null; repeated rows stay repeated in the groups; extra columns, whatever their names,
don't matter to the groups and pass through ``keep_one``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import connected_components
from . import near_copies
from .common import checkpoint, scratch

SHINGLE = 3
SEED = 42
BITS = 2
#: Longest posting list whose pairs are compared one by one.
SHORT = 32


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of the k-word shingles of UTF-8 ``text`` (repeats count)."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, starts = b" ".join(words), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest, width = xxhash.xxh64_intdigest, min(k, len(words))
    count = len(words) - width + 1
    h = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, 100_000):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + 100_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x.as_py(), k) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Bits of each pair of the four 16-bit blocks.
_MASKS = [_signed(0xFFFF << 16 * i | 0xFFFF << 16 * j) for i, j in combinations(range(4), 2)]


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) links that join all distinct fingerprints within ``bits`` (2 at most) of each other into their components.

    Every row is a true link. Short posting lists give each of their pairs that the tally and the bit
    count keep; a long one gives, for each value one bit away from its members, links to the smallest
    member next to that value.
    """
    if bits > 2:
        raise ValueError("two blocks of four stay whole for two differing bits at most")
    masks = F.array(*[F.lit(m) for m in _MASKS])
    entries = F.array(*[F.struct(F.lit(n).alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for n, m in enumerate(_MASKS)])
    lists = checkpoint(fps.select("fp", F.explode(entries).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1))
    pairs = (
        lists.filter(F.size("fps") <= SHORT).select("fps", F.explode("fps").alias("u"))
        .select("u", F.explode(F.filter("fps", lambda x: x < F.col("u"))).alias("v"))
    )
    shared = sum(((_byte(F.col("u"), i) == _byte(F.col("v"), i)).cast("int") for i in range(8)), F.lit(0))
    differing = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    near = pairs.filter(shared >= 8 - bits).filter(differing <= bits)
    # long lists: the centres are each member and its neighbours at one bit outside the key
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(_signed(1 << b) for b in range(64)))])
    mask = F.element_at(masks, F.col("at.set") + 1)
    ball = lists.filter(F.size("fps") > SHORT).select("at", F.explode("fps").alias("fp")).select(
        "at.set", "fp", F.explode(F.transform(F.filter(flips, lambda b: b.bitwiseAND(mask) == 0), lambda b: F.col("fp").bitwiseXOR(b))).alias("centre")
    )
    least = ball.groupBy("set", "centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("set", "centre", "v")
    star = ball.join(least, ["set", "centre"]).select(F.col("fp").alias("u"), "v").filter("u != v").filter(differing <= bits)
    return near.union(star).distinct()


def _rooted(own: DataFrame, bits: int) -> DataFrame:
    """(fp, root) of every fingerprint that is linked to another."""
    return connected_components(links(own.select("fp").distinct(), bits)).withColumnRenamed("node", "fp")


def simhash_groups(docs: DataFrame, text: str = "text", k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    own = scratch(fingerprints(docs, text, k), "simhash")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = fps.join(_rooted(own, bits), "fp", "left")
    # linked fingerprints take the name of their component, all others their own
    roots = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = named.filter("root is not null").join(roots, "root").select("fp", "component_id")
    alone = named.filter("root is null").select("fp", F.col("first").alias("component_id"))
    return own.join(linked.union(alone), "fp").select("doc_id", "fp", "component_id")


#: Rows to leave out (about 50 bytes each) up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def keep_one(docs: DataFrame, text: str = "text", k: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """One row of each group of near copies: smallest doc_id (null after all others), then smallest digest of the text.

    Texts whose k-word shingles are as similar as asked are linked (see near_copies). Which rows go is
    decided on (doc_id, digest) alone. Only the rows to leave out are joined to the documents, as a
    broadcast where their number allows it, so that texts stay where they are. Rows that agree in doc_id
    and text are one document: one of them stays.
    """
    own = scratch(near_copies.signatures(docs, text, k), "near")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")
    rows = own.groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n"))
    classes = own.groupBy("class").agg(F.min(rank).alias("best"))
    rooted = classes.join(near_copies.similar_classes(docs, own, text, k, similarity), "class", "left")
    linked = rooted.filter("root is not null").groupBy("root").agg(F.min("best").alias("best")).select("best")
    best = rooted.filter("root is null").select("best").union(linked).select("best.doc_id", "best.digest", F.lit(True).alias("stays"))
    told = rows.join(best, rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["digest"] == best["digest"]), "left").filter("stays is null or n > 1")
    told = scratch(told.select(rows["doc_id"].alias("_d"), rows["digest"].alias("_h"), F.coalesce("stays", F.lit(False)).alias("_stays")), "near")
    n, repeated = told.agg(F.count("*"), F.count_if("_stays")).first()
    if not n:
        return docs
    digest = F.xxhash64(F.col(text).cast("string"))
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), digest.alias("_digest"))
    told = F.broadcast(told) if n <= BROADCAST_ROWS else told.hint("shuffle_hash")
    met = named.join(told, named["_id"].eqNullSafe(told["_d"]) & (named["_digest"] == told["_h"]), "left")
    out = met.filter("_stays is null").select("_row.*")
    if repeated:  # map-side combining leaves one row per task and repeated document
        out = out.union(met.filter("_stays").groupBy("_id", "_digest").agg(F.first("_row").alias("_row")).select("_row.*"))
    return out
