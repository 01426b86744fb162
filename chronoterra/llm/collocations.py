"""Phrase collocations from depth-limited count tries.

1. A task counts all phrases of up to DEPTH words of about SHARD_WORDS words in a trie by language: a
   level is the sorted distinct pairs (parent node, word) with their counts, found for all words of the
   shard at once. The trie is serialised in depth-first order (depth, word, count) as compressed Arrow
   bytes with a sorted dictionary, and written to the shared folder with every SAMPLE-th path beside it.
2. The sampled paths give bounds of prefix ranges of about RANGE_NODES nodes (bounds set the balance,
   never the result). Each trie is cut at the bounds, and the parts of a range are merged in one task,
   RANGE_NODES nodes at a time: sorted runs, equal paths added up. Nodes under the least count go.
   A range may begin inside the children of a hot prefix, so no prefix is too large for a task.
3. What is left is closed under prefixes and suffixes, as a part of a phrase is at least as frequent. A
   trie walk gives each phrase the counts of its left parts: its ancestors in depth-first order. Its
   suffix links are its words turned round by one or more places: turned so, its right part is an
   ancestor in the same order, and the same walk answers. Subtrees are dealt by first word and a salt of
   the second, first words to every salt.
4. Scores are exact in decimals; phrases inside more frequent longer ones go; each language is ranked.

Defined cases: a null or empty text has no words, a null lang is ``und``; very long texts are counted
whole, in parts that end at breaks, which no phrase crosses; repeated rows count as often as they are there; ties are ranked by phrase; extra columns, whatever their names,
don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

DEPTH = 3
LEAST = 10
TOP = 2000
#: Percentage of a phrase's count at which a longer phrase stands for it.
INSIDE = 50
#: Words of a trie: they decide a task's memory; fewer make more nodes in all (1.38 a word at 800,000, 1.48 at 400,000).
SHARD_WORDS = 400_000
RANGE_NODES = 500_000
MAX_RANGES = 20_000
#: Nodes of a row of a serialised trie.
CHUNK_NODES = 65_536
SAMPLE = 8192
#: Sampled paths per range that the driver sorts.
PER_RANGE = 20
SALTS = 16
STEP_BYTES = 4_000_000
UNKNOWN = "und"

_WORD, _SPACE, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- words -----------------------------------------------------------------------------------


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lower-case words, their document, their piece) of documents at offsets ``at`` of ``raw``."""
    cls = _CLASS[raw]
    inside = cls == _WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    if not len(start):
        return pa.array([], pa.binary()), start, start
    doc = np.searchsorted(at, start, side="right") - 1
    piece = np.cumsum(cls == _BREAK)[start] + doc  # grows at every break and every new document
    size = np.add.reduceat(inside.astype(np.int64), start)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]])])
    return words, doc, piece


class Shard:
    """Words of some texts as codes of one dictionary."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.roots: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.words, self.last_piece = 0, 0

    def add(self, raw: np.ndarray, at: np.ndarray, langs: list[str]) -> None:
        words, doc, piece = words_of(raw, at)
        if not len(doc):
            return
        coded = words.dictionary_encode()
        own = np.array([self.known.setdefault(w, len(self.known)) for w in coded.dictionary.to_pylist()], np.int64)
        root = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        self.codes.append(own[coded.indices.to_numpy()].astype(np.int32))
        self.roots.append(root[doc].astype(np.int16 if len(self.langs) < 1 << 15 else np.int32))
        self.pieces.append(piece + self.last_piece + 1)
        self.last_piece = int(self.pieces[-1][-1])
        self.words += len(doc)


# ---- tries -----------------------------------------------------------------------------------


class Trie:
    """Nodes in depth-first order: paths (nodes x (1 + depth), 0 beyond the node's depth) and counts.

    Column 0 is the language's place in ``langs`` + 1, the others are places in the sorted ``words`` + 1.
    """

    def __init__(self, langs: list[str], words: pa.Array, paths: np.ndarray, counts: np.ndarray):
        self.langs, self.words, self.paths, self.counts = langs, words, paths, counts

    @staticmethod
    def of(shard: Shard, depth: int) -> Trie:
        langs = sorted(shard.langs)
        words = pa.array(sorted(shard.known), pa.binary())
        rank = np.empty(len(words), np.int64)
        rank[[shard.known[w] for w in words.to_pylist()]] = np.arange(len(words))
        of_lang = np.empty(len(langs), np.int64)
        of_lang[[shard.langs[x] for x in langs]] = np.arange(len(langs))
        code, v = rank[np.concatenate(shard.codes)], len(words)
        piece = np.concatenate(shard.pieces)
        parent, valid = of_lang[np.concatenate(shard.roots)], np.ones(len(code), bool)
        above, levels = (np.arange(len(langs)) + 1)[:, None].astype(np.int32), []
        for level in range(depth):
            if level:
                valid = valid[:-1] & (piece[level:] == piece[: len(piece) - level])
                parent = parent[: len(valid)]
            keys, node, count = np.unique((parent * v + code[level:])[valid], return_inverse=True, return_counts=True)
            above = np.concatenate([above[keys // v], (keys % v + 1)[:, None].astype(np.int32)], axis=1)
            levels.append((above, keys // v, count))
            parent = np.full(len(valid), -1, np.int64)
            parent[valid] = node
        # depth-first places: a node comes after its parent and the subtrees of its lesser siblings
        size, places = np.zeros(0, np.int64), []
        for _, up, _ in reversed(levels):
            size = 1 + (size if len(size) == len(up) else np.zeros(len(up), np.int64))
            places.append(size)
            size = np.bincount(up, size, len(langs) if len(places) == depth else len(levels[depth - len(places) - 1][1])).astype(np.int64)
        total = int(size.sum())
        paths, counts = np.zeros((total, depth + 1), np.int32), np.zeros(total, np.int64)
        at = np.cumsum(size) - size - 1  # before the first node of each language
        for level, (rows, up, count) in enumerate(levels):
            own = places[depth - 1 - level]
            before = np.cumsum(own) - own
            first = np.searchsorted(up, up)
            at = at[up] + 1 + before - before[first]
            paths[at, : level + 2], counts[at] = rows, count
        return Trie(langs, words, paths, counts)

    def slice(self, lo: int, hi: int) -> Trie:
        """A range of nodes with the words and languages that it needs."""
        paths = self.paths[lo:hi]
        used = np.zeros(len(self.words) + 1, bool)
        used[paths[:, 1:]] = True
        used[0] = False
        new = np.where(used, np.cumsum(used), 0).astype(np.int32)
        words = self.words.take(pa.array(np.flatnonzero(used) - 1))
        return Trie(self.langs, words, np.concatenate([paths[:, :1], new[paths[:, 1:]]], axis=1), self.counts[lo:hi])

    def dump(self) -> bytes:
        """Arrow bytes: of each node its depth, its last word and its count; the first one's path is whole."""
        paths, counts = self.paths, self.counts
        if len(counts):  # the first node's ancestors come before it, with no count of their own
            lead = np.repeat(paths[:1], max(0, int((paths[0, 1:] > 0).sum()) - 1), axis=0)
            lead[:, 1:] *= np.tri(*lead[:, 1:].shape, dtype=np.int32)
            paths, counts = np.concatenate([lead, paths]), np.concatenate([np.zeros(len(lead), np.int64), counts])
        depth = (paths[:, 1:] > 0).sum(axis=1)
        word = pa.DictionaryArray.from_arrays(pa.array((paths[np.arange(len(depth)), depth] - 1).astype(np.int32)), self.words)
        batch = pa.RecordBatch.from_arrays([pa.array(depth.astype(np.uint8)), word, pa.array(counts), pa.array(paths[:, 0].astype(np.int32))], ["depth", "word", "count", "lang"])
        sink = pa.BufferOutputStream()
        schema = batch.schema.with_metadata({f"lang{i}": x for i, x in enumerate(self.langs)} | {"levels": str(self.paths.shape[1] - 1)})
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(data: bytes) -> Trie:
        table = pa.ipc.open_stream(data).read_all()
        batch, meta = table.combine_chunks().to_batches(), table.schema.metadata
        levels = int(meta[b"levels"])
        langs = [meta[f"lang{i}".encode()].decode() for i in range(len(meta) - 1)]
        if not batch:
            return Trie(langs, pa.array([], pa.binary()), np.zeros((0, levels + 1), np.int32), np.zeros(0, np.int64))
        depth, word, count, lang = batch[0].columns
        depth, last = depth.to_numpy(), word.indices.to_numpy() + 1
        place = np.arange(len(depth))
        cols = [lang.to_numpy()]
        for d in range(1, levels + 1):  # the last node of depth d is the ancestor of all below it
            at = np.maximum.accumulate(np.where(depth == d, place, 0))
            cols.append(np.where(depth >= d, last[at], 0))
        paths, counts = np.stack(cols, axis=1).astype(np.int32), count.to_numpy()
        keep = counts > 0
        return Trie(langs, word.dictionary, paths[keep], counts[keep])

    def spelled(self, at: np.ndarray) -> list[tuple[str, ...]]:
        """Paths of some nodes as a language and words."""
        words = self.words
        return [(self.langs[p[0] - 1], *[words[int(x) - 1].as_py() for x in p[1:] if x]) for p in self.paths[at]]

    def places(self, bounds: list[tuple]) -> np.ndarray:
        """Of each bound (a spelled path), the first node at or after it."""
        words, langs = self.words.to_pylist(), self.langs
        out = []
        for lang, *path in bounds:
            i = bisect_left(langs, lang)
            lo, hi = np.searchsorted(self.paths[:, 0], [i + 1, i + 2]).tolist()
            exact = i < len(langs) and langs[i] == lang
            for d, w in enumerate(path, 1):
                if not exact or lo >= hi:
                    break
                i = bisect_left(words, w)
                exact = i < len(words) and words[i] == w
                column = self.paths[lo:hi, d]
                a, b = np.searchsorted(column, [i + 1, i + 2]).tolist()
                lo, hi = lo + a, lo + b
            out.append(lo)
        return np.array(out, np.int64)


def merged(tries: list[Trie]) -> Trie:
    """Sorted runs into one; equal paths become one node with the sum of their counts."""
    langs = sorted({x for t in tries for x in t.langs})
    coded = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(order), np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    places, runs, at = rank[coded.indices.to_numpy()], [], 0
    for t in tries:
        own = np.concatenate([[0], places[at : at + len(t.words)]]).astype(np.int32)
        own_lang = np.array([0, *[langs.index(x) + 1 for x in t.langs]], np.int32)
        runs.append(np.concatenate([own_lang[t.paths[:, :1]], own[t.paths[:, 1:]]], axis=1))
        at += len(t.words)
    paths, counts = np.concatenate(runs), np.concatenate([t.counts for t in tries])
    if not len(counts):
        return Trie(langs, words, paths, counts)
    bits = [max(1, int(paths[:, i].max()).bit_length()) for i in range(paths.shape[1])]
    if sum(bits) < 64:  # one number per path; the stable sort merges runs
        key = reduce(lambda k, i: k << bits[i] | paths[:, i], range(1, len(bits)), paths[:, 0].astype(np.int64))
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort(paths.T[::-1])
        new = np.concatenate([[True], (np.diff(paths[order], axis=0) != 0).any(axis=1)])
    first = np.flatnonzero(new)
    return Trie(langs, words, paths[order[first]], np.add.reduceat(counts[order], first))


# ---- the jobs --------------------------------------------------------------------------------


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text of about STEP_BYTES that end at breaks, which no phrase crosses."""
    lo = 0
    while lo < len(raw):
        hi = lo + STEP_BYTES
        while hi < len(raw) and not len(stops := np.flatnonzero(_CLASS[raw[hi - STEP_BYTES : hi]] == _BREAK)):
            hi += STEP_BYTES  # a piece of over STEP_BYTES stays whole
        hi = hi - STEP_BYTES + int(stops[-1]) + 1 if hi < len(raw) else len(raw)
        yield raw[lo:hi]
        lo = hi


_PATH = "array<binary>"


def shard_tries(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH) -> DataFrame:
    """(trie, nodes, sample) of every shard."""
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))

    def told(shard: Shard) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(shard, depth)
        for lo in range(0, len(trie.counts), CHUNK_NODES):
            part = trie.slice(lo, lo + CHUNK_NODES)
            spelled = part.spelled(np.arange(SAMPLE // 2, len(part.counts), SAMPLE))
            sample = [[p[0].encode(), *p[1:]] for p in spelled]
            yield pa.RecordBatch.from_arrays([pa.array([part.dump()], pa.binary()), pa.array([len(part.counts)], pa.int64()), pa.array([sample], pa.list_(pa.list_(pa.binary())))], ["trie", "nodes", "sample"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()

        def put(raw, at, langs):
            nonlocal shard
            shard.add(raw, at, langs)
            if shard.words >= SHARD_WORDS:
                yield from told(shard)
                shard = Shard()

        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            i = 0
            while i < len(size):
                if size[i] > STEP_BYTES:
                    for part in _parts(np.frombuffer(texts[i].as_buffer(), np.uint8)):
                        yield from put(part, np.array([0, len(part)]), [langs[i]])
                    i += 1
                    continue
                j, total = i, 0
                while j < len(size) and total + size[j] <= STEP_BYTES:
                    total += size[j]
                    j += 1
                raw = np.frombuffer(b"".join(x.as_buffer() for x in texts.slice(i, j - i) if x.is_valid), np.uint8)
                yield from put(raw, np.concatenate([[0], np.cumsum(size[i:j])]), langs[i:j])
                i = j
        if shard.words:
            yield from told(shard)
        pa.default_memory_pool().release_unused()  # the process lives on between tasks

    return own.mapInArrow(run, f"trie binary, nodes long, sample array<{_PATH}>")


def prefix_bounds(tries: DataFrame) -> list[tuple]:
    """Bounds of prefix ranges of about RANGE_NODES nodes, from the sampled paths; MAX_RANGES at most."""
    nodes = tries.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    ranges = min(MAX_RANGES, math.ceil(nodes / RANGE_NODES))
    if ranges < 2:
        return []
    rate = min(1.0, PER_RANGE * ranges * SAMPLE / nodes)
    paths = tries.select(F.explode("sample").alias("path")).sample(rate, seed=7).collect()
    told = sorted({(bytes(p[0]).decode(), *map(bytes, p[1:])) for (p,) in paths})
    step = len(told) / ranges
    return sorted({told[int(step * i)] for i in range(1, ranges)}) if told else []


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(lang, words array<string>, f): phrases of ``least`` occurrences or more; empty words have all words' number."""
    tries = scratch(shard_tries(docs, text, lang, depth), "tries")
    held = docs.sparkSession.sparkContext.broadcast(prefix_bounds(tries))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                trie = Trie.load(data.as_py())
                if not len(trie.counts):
                    continue
                # only bounds between the first and the last path: a row is a short part of all ranges
                least, most = trie.spelled(np.array([0, len(trie.counts) - 1]))
                first = bisect_left(held.value, least)
                near = held.value[first : bisect_right(held.value, most)]
                at = [0, *trie.places(near).tolist(), len(trie.counts)]
                for i, (lo, hi) in enumerate(zip(at, at[1:], strict=False), first):
                    if lo < hi:
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([trie.slice(lo, hi).dump()], pa.binary())], ["part", "trie"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Trie] = []
        part, size = None, 0

        def settle() -> Iterator[pa.RecordBatch]:
            trie = merged(waiting)
            heads = (trie.paths[:, 1] > 0) & ((trie.paths[:, 2:] > 0).sum(axis=1) == 0)
            for i, x in enumerate(trie.langs):
                if n := int(trie.counts[heads & (trie.paths[:, 0] == i + 1)].sum()):
                    yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([[]], pa.list_(pa.string())), pa.array([n], pa.int64())], ["lang", "words", "f"])
            keep = np.flatnonzero(trie.counts >= least)
            for i in range(0, len(keep), 50_000):
                at = keep[i : i + 50_000]
                p = trie.paths[at]
                flat = p[:, 1:][p[:, 1:] > 0] - 1
                ends = np.concatenate([[0], np.cumsum((p[:, 1:] > 0).sum(axis=1))]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), trie.words.take(pa.array(flat)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(trie.langs).take(pa.array(p[:, 0] - 1)), words, pa.array(trie.counts[at])], ["lang", "words", "f"])

        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p != part and waiting:
                    yield from settle()
                    waiting, size = [], 0
                part = p
                waiting.append(Trie.load(data.as_py()))
                size += len(waiting[-1].counts)
                if size > RANGE_NODES and len(waiting) > 1:
                    waiting = [merged(waiting)]
                    size = min(size // 2, len(waiting[0].counts) // 2)  # room for as much again
        if waiting:
            yield from settle()
        pa.default_memory_pool().release_unused()

    parts = tries.select("trie").mapInArrow(cut, "part int, trie binary")
    ranges = parts.repartition("part").sortWithinPartitions("part")
    return ranges.mapInArrow(merge, "lang string, words array<string>, f long")


def part_counts(phrases: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(lang, words, k, f, left, right): the phrase's count and those of both parts of every cut after k words.

    Own rows and those turned round by k places are sorted into the trie's order; a task walks them with
    the last node of every depth at hand.
    """
    turned = [(0, F.col("words"))] + [(k, F.concat(F.slice("words", k + 1, depth), F.slice("words", 1, k))) for k in range(1, depth)]
    rows = reduce(DataFrame.union, [
        phrases.filter(F.size("words") > k).select("lang", w.alias("path"), F.lit(k).alias("turn"), F.size("words").alias("m"), "f") for k, w in turned
    ])
    # a node comes before what hangs below it; one-word nodes go to every salt, all else by its second word
    salts = F.when(F.size("path") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64(F.get("path", F.lit(1))), F.lit(SALTS)).cast("int")))
    dealt = rows.select(F.explode(salts).alias("salt"), F.get("path", F.lit(0)).alias("head"), "*").repartition("lang", "head", "salt")
    ordered = dealt.sortWithinPartitions("lang", "head", "salt", "path", "turn").select("lang", "path", "turn", "m", "f")
    names = ["lang", "path", "turn", "f", "k", "count"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = np.zeros(depth + 1, np.int64)
        for b in batches:
            turn, m, f = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            place, node = np.arange(len(turn)), turn == 0
            above = np.zeros((depth + 1, len(turn)), np.int64)
            for d in range(1, depth + 1):
                at = np.maximum.accumulate(np.where(node & (m == d), place, -1))
                above[d] = np.where(at >= 0, f[np.maximum(at, 0)], stack[d])
            stack = above[:, -1] if len(turn) else stack
            # own rows ask for the first k words, turned ones for the last m - turn
            asked = [(place[node & (m > k)], np.full(int((node & (m > k)).sum()), k), k) for k in range(1, depth)]
            links = place[~node]
            for at, k, level in [*asked, (links, turn[links], m[links] - turn[links])]:
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(4), pa.array(k.astype(np.int32)), pa.array(above[level, at])], names)

    found = ordered.mapInArrow(walk, "lang string, path array<string>, turn int, f long, k int, count long")
    rest = F.size("path") - F.col("turn")
    words = F.concat(F.slice("path", rest + 1, F.col("turn")), F.slice("path", F.lit(1), rest))
    told = found.select("lang", words.alias("words"), "k", "f", F.when(F.col("turn") == 0, F.col("count")).alias("left"), F.when(F.col("turn") > 0, F.col("count")).alias("right"))
    return told.groupBy("lang", "words", "k").agg(F.max("f").alias("f"), F.max("left").alias("left"), F.max("right").alias("right"))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``depth`` words."""
    counts = scratch(phrase_counts(docs, text, lang, depth, least), "phrases")
    totals = counts.filter(F.size("words") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = counts.filter(F.size("words") > 0)
    cuts = part_counts(phrases, depth).select("*", _exact("f").alias("a"), (_exact("left") * _exact("right")).alias("lr"))
    scored = cuts.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * a * a div lr"))
    best = scored.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "left", "right", "f")).alias("b"))
    found = best.select("lang", "words", F.col("b.f").alias("a"), F.col("b.left").alias("l"), F.col("b.right").alias("r"), F.col("b.score").alias("score"))
    pieces = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    longer = found.filter(F.size("words") > 2).select("lang", "a", F.explode(pieces).alias("words"))
    cover = longer.groupBy("lang", "words").agg(F.max("a").alias("longest"))
    kept = found.join(cover, ["lang", "words"], "left").filter(f"longest is null or 100 * longest < {inside} * a")
    rows = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    least_rows = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top).drop("rank")
    ranked = least_rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
