"""Near copies by shingle similarity, over a byte-position inverted index with count filtering.

The 64 bits of a SimHash differ in 2 to 14 places between texts whose five-word shingles agree to 0.8,
which no index of its bytes can serve. For this measure a fingerprint is longer: BYTES positional bytes,
each the last one of a min-hash, so that two texts share a positional byte about as often as a shingle.

* Index: BLOCK neighbouring bytes and their place are the key of a posting list.
* Tally: all shared positional bytes of two texts that meet in a list are counted; pairs under LEAST are
  dropped. At a similarity of 0.8, a pair meets in some list and reaches LEAST with a probability of 0.999.
* Verify: the similarity of a kept pair is taken from both whole sets of shingles.

Equal texts are one entry. A list of over SHORT texts isn't expanded into its pairs: each text meets the
centres of the list and of its part of it (the text that meets most others in all its lists: a family's
common source), one more text that differs by list, and its two neighbours in the order of the whole
fingerprint. First each text's best pair is verified; of the others, only those between different groups.
Then the pairs of long lists that are still in different groups are all tallied, block by block. What they
join are families, whose texts meet once more, block by block, with their sets of shingles, and are verified there.

Defined cases: null texts and texts without words are equal to each other and to nothing else; texts of
fewer than ``k`` words are one shingle; very long texts are read whole; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clusters import connected_components
from .common import scratch

SHINGLE, SIMILARITY = 5, 0.8
BYTES, BLOCK, LEAST = 144, 6, 98
#: Longest posting list whose pairs are all looked at.
SHORT = 24
#: Texts from which a list is hot: it is broadcast, so that its texts aren't shuffled by it; HOT_LISTS of them at most.
HOT, HOT_LISTS = 1000, 50_000
#: Texts of a long list, about, that have a centre of their own.
PART = 1000
#: Texts of a block of a long list whose groups are compared in full.
BLOCK_TEXTS = 1000
#: Bytes of sets of shingles of a block, about: one of long texts has fewer of them.
BLOCK_BYTES = 16_000_000
#: Texts with a candidate (8 bytes each) up to which their numbers are broadcast to find the texts again.
BROADCAST_CLASSES = 2_000_000
_WORDS_KEPT = 200_000

_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(1, 2**63, BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, BYTES, dtype=np.uint64)


class Shingles:
    """Hashes of the k-word shingles of texts; words are hashed once as long as they are remembered."""

    def __init__(self, k: int):
        self.k, self.known = k, {}
        self.mix = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1 for i in range(k)], np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Distinct shingles of UTF-8 ``text``, sorted."""
        words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.array([], np.uint64)
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = max(1, len(h) - self.k + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(self.k, len(h))):
            out += h[i : i + n] * self.mix[i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


def signature(shingles: np.ndarray) -> bytes:
    """BYTES positional bytes of a set of shingles."""
    best = np.full(BYTES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        best = np.minimum(best, (shingles[i : i + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return ((best >> np.uint64(16)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, class, sig): class is one number for equal texts, and for all texts without words; those have no sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(k)
        for b in batches:
            sigs = [signature(s) if len(s := of(t.as_py())) else None for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.binary())], ["doc_id", "digest", "sig"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("digest"), F.col(text).cast("string").cast("binary").alias("text"))
    made = own.mapInArrow(run, "doc_id long, digest long, sig binary")
    return made.select("doc_id", "digest", F.when(F.col("sig").isNull(), F.lit(0).cast("long")).otherwise(F.col("digest")).alias("class"), "sig")


def _lists(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (at, n, class) of the posting lists of classes (class, sig), and those of long lists with (sig, met, part)."""
    # a key is a number of the place and its bytes; fingerprints stay out of the lists
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", BLOCK * i + 1, BLOCK)) for i in range(BYTES // BLOCK)])
    entries = classes.select("class", F.explode(keys).alias("at"))
    lists = scratch(entries.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    total = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(HOT, total // HOT_LISTS)  # so HOT_LISTS of them at most
    crowded = entries.join(F.broadcast(lists.filter(hot)), "at")
    others = entries.join(F.broadcast(lists.filter(hot).select("at")), "at", "left_anti").join(lists.filter(~hot), "at")
    inside = crowded.unionByName(others).select("at", "n", "class")
    # long lists: the text that meets most others in all its lists is their centre, that of a part is another
    long = inside.filter(F.col("n") > SHORT)
    met = inside.groupBy("class").agg(F.sum("n").alias("met"))
    part = F.pmod(F.xxhash64("class"), F.least(F.ceil(F.col("n") / PART), F.lit(1_000_000)))
    dealt = scratch(long.join(met, "class").join(classes, "class").select("at", "class", F.substring("sig", 1, 16).alias("sig"), "met", part.alias("part")), "long")
    return inside, dealt


def _met(classes: DataFrame, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(u, v) of classes (class, sig) that meet in a posting list, u < v; of long lists, those with centres and neighbours."""
    inside, dealt = lists or _lists(classes)
    short = inside.filter(F.col("n") <= SHORT).groupBy("at").agg(F.collect_list("class").alias("all"))
    pairs = short.select("all", F.explode("all").alias("u")).select("u", F.explode(F.filter("all", lambda x: x > F.col("u"))).alias("v"))
    order = Window.partitionBy("at", "part").orderBy("sig", "class")
    next_ = dealt.select("class", F.lead("class").over(order).alias("other"))
    own = dealt.groupBy("at", "part").agg(F.max(F.struct("met", "class")).alias("most"), F.min_by("class", F.xxhash64("at", "class")).alias("any"))
    whole = own.groupBy("at").agg(F.max("most")["class"].alias("centre"))
    starred = dealt.join(own.join(whole, "at"), ["at", "part"]).select("class", F.explode(F.array("centre", "most.class", "any")).alias("other"))
    far = next_.union(starred).filter("other is not null and class <> other").select(F.least("class", "other").alias("u"), F.greatest("class", "other").alias("v"))
    return pairs.union(far).distinct()


def _dealt(named: DataFrame, tag: str) -> DataFrame | None:
    """(class, root, key, side, same): texts of lists (at, class, root, weight) for the pairs of blocks in which they meet those of other roots.

    Lists of one root are left alone. In the others each group of a weight over BLOCK_TEXTS is dealt to blocks
    of its own, the smaller ones to common blocks; a key holds two blocks (``side``), or one (``same``), and two
    blocks of one large group never meet. This grows with the texts of a list times those outside its largest group.
    """
    mixed = named.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("at")
    own = scratch(named.join(mixed, "at"), "mixed")
    groups = own.groupBy("at", "root").agg(F.sum("weight").alias("n"))
    small = groups.filter(F.col("n") <= BLOCK_TEXTS).groupBy("at").agg(F.sum("n").alias("all_small"))
    sized = groups.join(small, "at", "left").withColumn("large", F.col("n") > BLOCK_TEXTS)
    blocks = F.ceil(F.when(F.col("large"), F.col("n")).otherwise(F.col("all_small")) / BLOCK_TEXTS)
    part = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("class")).otherwise(F.col("root"))), F.col("blocks"))
    placed = own.join(sized.select("at", "root", "large", blocks.alias("blocks")), ["at", "root"])
    placed = scratch(placed.select("at", "class", "root", F.struct(F.when(F.col("large"), F.col("root")).alias("of"), part.alias("part")).alias("block")), tag)
    if placed.isEmpty():
        return None
    of_list = placed.select("at", "block").distinct().groupBy("at").agg(F.collect_list("block").alias("others"))
    meet = F.filter("others", lambda o: F.col("block.of").isNull() | o["of"].isNull() | (o["of"] != F.col("block.of")))
    pair = lambda o: F.struct(F.xxhash64("at", F.least("block", o), F.greatest("block", o)).alias("key"), (F.col("block") > o).alias("side"), (F.col("block") == o).alias("same"))
    return placed.join(of_list, "at").select("class", "root", F.explode(F.transform(meet, pair)).alias("p")).select("class", "root", "p.*")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a sorted first column, one key at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), len(key)], strict=True):
            if held and hi > lo and held[0].column(0)[0].as_py() != int(key[lo]):
                yield pa.Table.from_batches(held)
                held.clear()
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _shared(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of rows (key, side, same, ..., sig): each text of the first block, and those of the other that share LEAST positional bytes with it."""
    side, same = (t.column(i).to_numpy() for i in (1, 2))
    sig = np.frombuffer(b"".join(x.as_buffer() for x in t.column("sig")), np.uint8).reshape(-1, BYTES)
    a, b = (np.flatnonzero(~side), np.arange(len(side)) if same[0] else np.flatnonzero(side))
    for lo in range(0, len(a), 16):
        shared = (sig[a[lo : lo + 16]][:, None, :] == sig[b][None]).sum(axis=2)
        for i, row in zip(a[lo : lo + 16].tolist(), shared, strict=True):
            yield i, b[row >= LEAST]


def _rest(long: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(u, v), u < v: what the pairs in long lists (at, class) that share LEAST positional bytes and have different roots join, as links.

    The pairs themselves grow with the square of a family; a task hands on no more links than it has texts,
    from the least text of each family in its two blocks to the others.
    """
    named = long.select("at", "class").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("at", "class", F.coalesce("root", "class").alias("root"), F.lit(1).alias("weight"))
    dealt = _dealt(named, "blocks")
    if dealt is None:
        return None
    ordered = dealt.join(classes, "class").select("key", "side", "same", "class", "root", "sig").repartition("key").sortWithinPartitions("key", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            name, root = (t.column(i).to_numpy() for i in (3, 4))
            family = np.arange(len(name))
            for i, met in _shared(t):
                met = met[root[met] != root[i]]
                if len(other := np.unique(family[met])) and (len(other) > 1 or other[0] != family[i]):
                    family[np.isin(family, other)] = family[i]
            order = np.lexsort((name, family))
            first = np.flatnonzero(np.diff(family[order], prepend=-1))
            least = np.repeat(name[order[first]], np.diff(first, append=len(order)))
            links = least != name[order]
            yield pa.RecordBatch.from_arrays([pa.array(least[links]), pa.array(name[order][links])], ["u", "v"])

    return ordered.mapInArrow(run, "u long, v long").distinct()


def _rest_verified(families: DataFrame, classes: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of all pairs in families (node, root) that share LEAST positional bytes, are of different ``roots`` and as similar as asked.

    Sets of shingles go with their texts to the blocks, not with the pairs; in a task, groups that a link
    joins are one from then on, so it hands on no more links than it has texts.
    """
    heavy = F.ceil(F.length("set") / BLOCK_BYTES * BLOCK_TEXTS)  # so that a block has BLOCK_BYTES of sets, about
    own = families.select(F.col("root").alias("at"), F.col("node").alias("class")).join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    named = own.join(sets.select("class", heavy.alias("weight")), "class").select("at", "class", F.coalesce("root", "class").alias("root"), F.greatest(F.lit(1).cast("long"), "weight").alias("weight"))
    dealt = _dealt(named, "family_blocks")
    if dealt is None:
        return families.select(F.col("node").alias("u"), F.col("root").alias("v")).limit(0)
    ordered = dealt.join(classes, "class").join(sets, "class").select("key", "side", "same", "class", "root", "sig", "set").repartition("key").sortWithinPartitions("key", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            name, root = t.column(3).to_numpy(), t.column(4).to_numpy().copy()
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column(6)]
            u, v = [], []
            for i, met in _shared(t):
                own = sets[i]
                met = met[root[met] != root[i]]
                for lo in range(0, len(met), 64):
                    some = met[lo : lo + 64]
                    some = some[root[some] != root[i]]  # what a link of the part before joined is done
                    if not len(some):
                        continue
                    size = np.array([len(sets[j]) for j in some])
                    other = np.concatenate([sets[j] for j in some])
                    at = np.searchsorted(own, other)
                    both = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == other).astype(np.int64), np.cumsum(size) - size)
                    for j in some[both >= similarity * (len(own) + size - both) - 1e-9].tolist():
                        if root[j] != root[i]:
                            u.append(int(min(name[i], name[j])))
                            v.append(int(max(name[i], name[j])))
                            root[root == root[j]] = root[i]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return ordered.mapInArrow(run, "u long, v long").distinct()


def _tallied(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, shared): pairs that share LEAST positional bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(x.as_buffer() for x in b.column(i)), np.uint8).reshape(-1, BYTES) for i in (2, 3))
            shared = (a == c).sum(axis=1)
            keep = pa.array(np.flatnonzero(shared >= LEAST))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(shared).take(keep)], ["u", "v", "shared"])

    side = lambda n: classes.select(F.col("class").alias(n), F.col("sig").alias(f"{n}_sig"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_sig", "v_sig")
    return both.mapInArrow(run, "u long, v long, shared long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose sets of shingles are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = (np.frombuffer(s.as_buffer(), np.uint32) for s in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both) - 1e-9:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])

    side = lambda n: sets.select(F.col("class").alias(n), F.col("set").alias(f"{n}_set"))
    return pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def similar_classes(docs: DataFrame, own: DataFrame, text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(class, root) of the classes of ``own`` (see signatures) that are linked to another."""
    classes = scratch(own.filter("sig is not null").groupBy("class").agg(F.first("sig").alias("sig")), "classes")
    lists = _lists(classes)
    pairs = scratch(_tallied(_met(classes, lists), classes), "pairs")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(k)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = [np.unique(of(t.as_py()).astype(np.uint32)).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["class", "set"])

    digest = F.xxhash64(F.col(text).cast("string"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        involved = scratch(pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct(), "involved")
        small = involved.count() <= BROADCAST_CLASSES  # then texts stay where they are
        # one row of each class: sets are equal, so any will do
        seen = docs.select(digest.alias("class"), F.col(text).cast("string").cast("binary").alias("text")).join(F.broadcast(involved) if small else involved, "class", "left_semi").mapInArrow(shingled, "class long, set binary")
        return scratch(seen.groupBy("class").agg(F.first("set").alias("set")), "sets")

    sets = sets_of(pairs)
    both = pairs.select("u", "v", "shared").union(pairs.select("v", "u", "shared"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("shared", -F.col("v"))).alias("v"))
    first = scratch(_verified(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets, similarity), "links")
    roots = scratch(connected_components(first), "roots")
    named = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    across = pairs.join(named("u"), "u", "left").join(named("v"), "v", "left").filter("coalesce(u_root, u) <> coalesce(v_root, v)")
    links = scratch(first.union(_verified(across.select("u", "v"), sets, similarity)), "links")
    roots = scratch(connected_components(links), "roots")
    rest = _rest(lists[1], classes, roots)
    if rest is None:
        return roots.withColumnRenamed("node", "class")
    rest = scratch(rest, "rest")
    if rest.isEmpty():
        return roots.withColumnRenamed("node", "class")
    families = scratch(connected_components(rest), "families")
    more = scratch(_rest_verified(families, classes, roots, sets_of(rest), similarity), "links")
    return connected_components(links.union(more)).withColumnRenamed("node", "class")
