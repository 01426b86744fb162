"""The index of near copies against all pairs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from chronoterra.llm import near_copies, simhash

from ..oracle import SMALL


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_pairs(texts, k=5, least=0.8):
    """Pairs (i, j), i < j, of different texts with words that are as similar as asked: all of them, by an exact index."""
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    sets = {i: s for t, i in first.items() if (s := shingles(t, k))}
    lists, out = defaultdict(list), []
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in lists[x]:
                common[j] += 1
            lists[x].append(i)
        out += [(min(i, j), max(i, j)) for j, n in common.items() if n >= least * (len(s) + len(sets[j]) - n) - 1e-9]
    return out


def near_groups(texts):
    """The first of each text's group: equal texts, texts without words, and what near pairs join."""
    root, first = list(range(len(texts))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)

    for i, t in enumerate(texts):
        join(i, first.setdefault(t if shingles(t) else None, i))
    for i, j in near_pairs(texts):
        join(i, j)
    return [find(i) for i in range(len(texts))]


def family(r, n, words=120, edits=3):
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(words)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.keep_one(docs).collect())


@pytest.mark.parametrize("short", [24, 2])
def test_families_are_found_whole(spark, monkeypatch, short):
    monkeypatch.setattr(near_copies, "SHORT", short)  # 2: most lists take the way of long ones
    r = random.Random(short)
    texts = [t for _ in range(25) for t in family(r, r.choice([1, 2, 5, 12]))] + family(r, 90, edits=2) + [None, "", " \n ", "a b", "A B", "one two three four five six"]
    groups = near_groups(texts)
    assert kept(spark, texts) == sorted(set(groups))


def test_only_similar_texts_are_linked(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    changed = lambda n: " ".join(base[:-n] + [f"x{n}y{i}" for i in range(n)])
    # the last n words changed: 100 - n shingles of 100 + n are shared
    assert kept(spark, [" ".join(base), changed(11)]) == [0]  # 89 / 111
    assert kept(spark, [" ".join(base), changed(12)]) == [0, 1]  # 88 / 112


def test_recall_of_pairs(spark):
    r = random.Random(3)
    texts = [t for _ in range(150) for t in family(r, 2, edits=2)]
    want = set(near_pairs(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = near_copies.signatures(docs)
    of = {r.digest: r.doc_id for r in own.collect()}
    classes = own.select("class", "sig").distinct()
    met = near_copies._tallied(near_copies._met(classes), classes).collect()
    got = {tuple(sorted((of[x.u], of[x.v]))) for x in met}
    assert len(want) > 80 and len(want & got) >= 0.98 * len(want)


def test_signatures_share_bytes_as_often_as_shingles():
    r = random.Random(1)
    of = near_copies.Shingles(5)
    for _ in range(10):
        a, b = (t.encode() for t in family(r, 2, words=400, edits=20))
        x, y = of(a), of(b)
        both = len(np.intersect1d(x, y))
        similar = both / (len(x) + len(y) - both)
        p, q = (np.frombuffer(near_copies.signature(s), np.uint8) for s in (x, y))
        assert abs((p == q).mean() - similar) < 0.15


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(near_groups(texts)))


def test_a_hot_list(spark, monkeypatch):
    for name, value in {"HOT": 30, "PART": 40, "HOT_LISTS": 10**9}.items():
        monkeypatch.setattr(near_copies, name, value)
    r = random.Random(8)
    texts = family(r, 250, edits=2) + [t for _ in range(10) for t in family(r, 3)]
    assert kept(spark, texts) == sorted(set(near_groups(texts)))


@pytest.mark.parametrize("block", [1000, 7])
def test_members_of_long_lists_all_meet(spark, monkeypatch, block):
    """All texts share one long list: pairs apart from its centres and neighbours are found as well, each that reaches the tally."""
    monkeypatch.setattr(near_copies, "SHORT", 2)
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", block)
    r = np.random.default_rng(5)
    sigs = []
    for _ in range(30):  # 30 groups of two, which share 110 bytes or so; groups share the first block alone
        a = r.integers(0, 256, near_copies.BYTES, dtype=np.uint8)
        at = np.arange(near_copies.BYTES)  # no other block is shared, and the order in the list is another
        b = np.where((at % 5 == 2) | (at < 16), r.integers(0, 256, near_copies.BYTES, dtype=np.uint8), a)
        for x in (a, b):
            x[: near_copies.BLOCK] = 7
            sigs.append(bytearray(x.tobytes()))
    classes = spark.createDataFrame(list(enumerate(sigs)), "class long, sig binary")
    lists = near_copies._lists(classes)
    roots = spark.createDataFrame([(0, 0), (1, 0), *((i, 100) for i in range(40, 58))], "node long, root long")
    root = {x.node: x.root for x in roots.collect()}
    want = {(i, i + 1) for i in range(0, 60, 2) if root.get(i, i) != root.get(i + 1, i + 1)}
    met = {(x.u, x.v) for x in near_copies._tallied(near_copies._met(classes, lists), classes).collect()}
    assert not want <= met  # centres and neighbours alone miss some
    assert {(x.u, x.v) for x in near_copies._rest(lists[1], classes, roots).collect()} == want


def test_a_family_of_near_misses_is_no_list_of_pairs(spark, monkeypatch):
    """All pairs of a long list reach the tally: what is handed on is as many as the texts, and verification loses no link."""
    monkeypatch.setattr(near_copies, "SHORT", 2)
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 100)
    r = np.random.default_rng(9)
    base = r.integers(0, 256, near_copies.BYTES, dtype=np.uint8)
    n, sigs, sets = 240, [], []
    for i in range(n):  # texts 2i and 2i + 1 share 85 of 105 shingles, all others 80 of 120
        sigs.append(bytearray(np.where(np.arange(near_copies.BYTES) % 10 == i % 10, r.integers(0, 256, near_copies.BYTES, dtype=np.uint8), base).astype(np.uint8).tobytes()))
        own = [*range(80), *(10**6 + i // 2 * 15 + k for k in range(5)), *(10**7 + i * 15 + k for k in range(10))]
        sets.append((i, bytearray(np.array(own, np.uint32).tobytes())))
    classes = spark.createDataFrame(list(enumerate(sigs)), "class long, sig binary")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    long = classes.selectExpr("1L as at", "class")
    rest = near_copies._rest(long, classes, roots)
    assert n - 1 <= rest.count() <= 8 * n  # of 28,679 pairs
    families = near_copies.connected_components(rest)
    got = near_copies._rest_verified(families, classes, roots, spark.createDataFrame(sets, "class long, set binary"), 0.8)
    assert {(x.u, x.v) for x in got.collect()} == {(i, i + 1) for i in range(2, n, 2)}


def test_all_pairs_helper():
    texts = ["a b c d e f g", "a b c d e f g h", "x y", "x y", "q"]
    sets = [shingles(t) for t in texts]
    want = [(i, j) for i, j in combinations(range(5), 2) if texts[i] != texts[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near_pairs(texts, least=0.8) == want
