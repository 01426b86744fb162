"""Count tries and collocations against plain counting."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoterra.llm import collocations as co


def counted(rows, depth=3):
    out = defaultdict(Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    out["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    return out


def plain(rows, depth=3, least=10, top=2000, inside=50):
    found = []
    for lang, f in counted(rows, depth).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in cand.items():
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [c for q, c in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if all(100 * c < inside * a for c in longer):
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found)


def made(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "text string, lang string")
    return sorted(map(tuple, co.collocations(docs.repartition(4), **kw).collect()))


def sample(seed, n=150):
    r = random.Random(seed)
    vocab = ["new", "york", "The", "of", "é", "語", "x\x01", "x", "a", "b"] + [f"w{i}" for i in range(30)]
    weights = [12, 12, 30, 25, 6, 6, 3, 3, 10, 10] + [1] * 30
    text = lambda: "".join(w + r.choice([" ", " ", "  ", "\t", ", ", "\n", " - "]) for w in r.choices(vocab, weights, k=r.randrange(60)))
    fixed = ["New York City hall, the end of the end\n" * 3, None, "", " .,; \n"]
    return [(r.choice([text(), text(), r.choice(fixed)]), r.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_collocations_equal_plain_counting(spark, seed):
    rows = sample(seed)
    got = made(spark, rows)
    assert got == plain(rows) and len(got) > 20


def test_many_shards_ranges_and_parts(spark, monkeypatch):
    rows = sample(9, 300) + [("new york " * 2000 + ". the of, " * 500, "en")]
    for name, value in {"SHARD_WORDS": 200, "RANGE_NODES": 90, "CHUNK_NODES": 40, "SAMPLE": 7, "STEP_BYTES": 500}.items():
        monkeypatch.setattr(co, name, value)
    docs = spark.createDataFrame(rows, "text string, lang string")
    bounds = co.prefix_bounds(co.shard_tries(docs))
    assert len(bounds) > 10 and {len(b) for b in bounds} == {2, 3, 4}
    assert made(spark, rows) == plain(rows)


def test_other_depths(spark):
    rows = sample(4)
    for depth in (2, 4):
        assert made(spark, rows, depth=depth, least=5, inside=70) == plain(rows, depth, 5, inside=70)
    assert made(spark, rows, top=3) == plain(rows, top=3)


def test_hot_prefix_and_exact_scores(spark):
    rows = [(" ".join(["hot"] * 400 + [f"hot w{i}" for i in range(200) for _ in range(10)]), "en")]
    assert made(spark, rows) == plain(rows)
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 7_000_000_000_123  # 10^6 a^2 and l r pass 64 bits
    counts = {("a",): 3 * big, ("b",): 2 * big + 1, ("a", "b"): big}
    f = spark.createDataFrame([("en", list(w), c) for w, c in counts.items()], "lang string, words array<string>, f long")
    (r,) = co.part_counts(f).collect()
    assert (r.f, r.left, r.right) == (big, 3 * big, 2 * big + 1)


paths = st.dictionaries(st.tuples(st.sampled_from(["de", "en"]), st.lists(st.sampled_from([b"a", b"ab", b"a\x01", b"b", "é".encode()]), min_size=1, max_size=3).map(tuple)), st.integers(1, 9), min_size=1, max_size=40)


def trie_of(nodes):
    """All prefixes are there, as in any count trie."""
    whole = Counter()
    for (lang, p), c in nodes.items():
        for d in range(1, len(p) + 1):
            whole[lang, p[:d]] += c
    langs, words = sorted({x for x, _ in whole}), sorted({w for _, p in whole for w in p})
    rows = sorted([langs.index(lang) + 1, *[words.index(w) + 1 for w in p], *[0] * (3 - len(p))] + [c] for (lang, p), c in whole.items())
    rows = co.np.array(rows)
    return whole, co.Trie(langs, co.pa.array(words, co.pa.binary()), rows[:, :4].astype(co.np.int32), rows[:, 4])


def nodes_of(trie):
    return {(p[0], p[1:]): int(c) for p, c in zip(trie.spelled(co.np.arange(len(trie.counts))), trie.counts, strict=True)}


@settings(max_examples=150, deadline=None)
@given(paths, paths, st.lists(paths.map(lambda x: min(x)), max_size=4))
def test_tries_are_cut_and_merged_whole(one, two, at):
    a, left = trie_of(one)
    b, right = trie_of(two)
    assert nodes_of(co.Trie.load(left.dump())) == a
    bounds = sorted({(lang, *p) for lang, p in at})
    parts = []
    for t in (left, right):
        ends = [0, *t.places(bounds).tolist(), len(t.counts)]
        parts.append([co.Trie.load(t.slice(i, j).dump()) for i, j in zip(ends, ends[1:], strict=False)])
    total = Counter()
    for i, pair in enumerate(zip(*parts, strict=True)):
        got = nodes_of(co.merged(list(pair)))
        for lang, p in got:  # a node lies in the range that its path says
            assert sum((x[0], x[1:]) <= (lang, p) for x in bounds) == i
        assert not set(got) & set(total)
        total.update(got)
    assert total == a + b


def test_memory_of_a_shard():
    """The trie of a full shard and its rows, beside what reads the texts."""
    r = np.random.default_rng(4)
    shard = co.Shard()
    for _ in range(co.SHARD_WORDS // 20_000):
        words = [f"w{x}" for x in (r.pareto(0.6, 20_000) * 20).astype(np.int64) % 200_000]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        shard.add(raw, np.array([0, len(raw)]), ["en"])
    tracemalloc.start()
    trie = co.Trie.of(shard, co.DEPTH)
    for lo in range(0, len(trie.counts), co.CHUNK_NODES):
        trie.slice(lo, lo + co.CHUNK_NODES).dump()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90_000_000
