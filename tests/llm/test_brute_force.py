"""Operators without SQL against plain versions, round trips and held-out accuracy."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoterra.llm import decontamination, language_id, pii, queries, simhash, substring_dedup, toxicity
from chronoterra.operators import clusters

from ..oracle import SMALL
from .test_near_copies import near_groups


# ---- simhash ---------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB ÄÖ\t\n  \x1c\x85c", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == slow_fingerprint(text)


def components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("short", [32, 1])
def test_links_join_what_brute_force_joins(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT", short)  # 1: all lists take the way of long ones
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            w = v
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                w ^= 1 << b
            values.add(w)
    values |= {0, 1 << 63, (1 << 63) + 1}
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [(x.u, x.v) for x in simhash.links(fps).collect()]
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 2]
    assert {tuple(sorted(x)) for x in got} <= set(near)
    assert components(got) == components(near)


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    fp = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    links = [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    root = components(links)
    got = queries.QUERIES["op10_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", root.get(i, i)) for i, f in fp.items()}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_keep_one_is_exact_per_row(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    long = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    a, b, c = map(long, range(3))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, b + " more", "x"), (None, c, "y"), (None, long(3), "n"), (None, long(3), "n"), (8, c, "z"), (9, long(4), "p"), (9, long(4), "q"), (10, None, "e"), (11, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `f.p` string")
    kept_rows = simhash.keep_one(docs)
    assert kept_rows.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept_rows.collect()]
    groups = {}
    for (i, t, _), g in zip(rows, near_groups([t for _, t, _ in rows]), strict=True):
        groups.setdefault(g, set()).add((i, t))
    assert len(got) == len(groups) == 6
    for members in groups.values():
        known = {i for i, _ in members if i is not None}
        kept = [x for x in got if x in members]
        assert len(kept) == 1 and kept[0][0] == (min(known) if known else None)
    assert simhash.keep_one(docs.filter("false")).collect() == []


@pytest.mark.parametrize("heavy", [50_000, 3])
def test_components_with_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(clusters, "HEAVY", heavy)
    r = random.Random(4)
    edges = [(0, i) for i in range(1, 80)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(120)] + [(5, 300)]
    got = {x.node: x.root for x in clusters.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components(edges)


def test_components_of_a_long_chain(spark):
    n = 300
    chain = list(range(n))
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "u long, v long")
    assert {r.root for r in clusters.connected_components(edges).collect()} == {0}


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_rounds_of_a_small_graph_have_few_tasks(spark, broadcast):
    """However many partitions a shuffle has, rounds over a few links aren't dealt to all of them."""
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {k: spark.conf.get(k) for k in conf}
    sc, n = spark.sparkContext, 120
    edges = [(i, i * 7 % n) for i in range(n)] + [(i, i + 1) for i in range(0, n, 3)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup(f"small-graph-{broadcast}", "")
        got = {x.node: x.root for x in clusters.connected_components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).collect()}
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == components([(u, v) for u, v in edges if u != v])
    of = sc.statusTracker()
    stages = {s for j in of.getJobIdsForGroup(f"small-graph-{broadcast}") for s in of.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := of.getStageInfo(s)))
    assert 0 < tasks < 400  # some 50 each to find, write, count and read the links of the start; about 500 more a round when its steps shuffled


# ---- decontamination -------------------------------------------------------------------------


def slow_hits(doc, items, window=10):
    w, hit, found = decontamination.words(doc), set(), set()
    for item, text in items:
        p = decontamination.words(text)
        n = min(window, len(p))
        for i in range(len(p) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(hit), found


def test_wu_manber():
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n)).encode()
    for _ in range(300):
        items = [(str(i), text(r.randint(0, 7))) for i in range(5)]
        engine, doc = decontamination.WuManber(items, window=4), text(r.randint(0, 30))
        spans, found = engine.search(decontamination.words(doc))
        assert (decontamination.covered(spans), found) == slow_hits(doc, items, 4)


def test_many_passes_equal_one(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.union(docs.limit(3))
    read = lambda: sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    one, kept = read(), decontamination.drop_contaminated(docs, bench).count()
    monkeypatch.setattr(decontamination, "PASS_BYTES", 2_000)
    assert decontamination._passes(bench)[0] > 1
    assert read() == one
    assert decontamination.drop_contaminated(docs, bench).count() == kept


# ---- substring dedup -------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_tile_the_text(data):
    text = data.decode("utf-8", "replace")
    ends = substring_dedup.chunks(text.encode())
    raw, at = text.encode(), 0
    for e in ends:
        assert 0 < e - at <= substring_dedup.MOST
        raw[at:e].decode()  # no character is cut
        at = e
    assert at == len(raw)


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(substring_dedup.GEAR[b])) % 2**32
        want.append(h)
    assert substring_dedup.gear(data).tolist() == want


def test_repeats_go_and_the_first_stays(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op8_substring_dedup"](spark, SMALL).collect()}
    first = {}
    for i, t in sorted(docs):
        raw, a, runs = (t or "").encode(), 0, []
        for b in substring_dedup.chunks(raw):
            if first.setdefault(raw[a:b], (i, a)) != (i, a):
                runs = [*runs[:-1], (runs[-1][0], b)] if runs and runs[-1][1] == a else [*runs, (a, b)]
            a = b
        runs = [x for x in runs if x[1] - x[0] >= substring_dedup.MIN_RUN]
        assert got[i].removed == ",".join(f"{x}:{y}" for x, y in runs)
        assert got[i].n_removed == sum(y - x for x, y in runs) == got[i].n_bytes - len((got[i].text or "").encode())


def test_an_insertion_moves_few_borders():
    text = bytes(random.Random(9).choices(range(97, 123), k=20_000))
    cut = lambda t: {t[a:b] for a, b in zip([0, *substring_dedup.chunks(t)], substring_dedup.chunks(t))}
    assert len(cut(text) - cut(text[:5000] + b"inserted" + text[5000:])) <= 8


# ---- PII -------------------------------------------------------------------------------------

SPELLED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    good = {
        "email": lambda t: True,
        "ip": lambda t: all(int(x) <= 255 for x in t.split(".")),
        "card": lambda t: 16 <= len(digits(t)) <= 19 and sum(int(c) for i, d in enumerate(digits(t)[::-1]) for c in str(int(d) * (1 + i % 2))) % 10 == 0,
        "phone": lambda t: 8 <= len(digits(t)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if good[k](m.group())] for k, p in SPELLED.items()}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ 0125()é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_spans_of_documents(spark):
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert pii.base_spans(r.text or "") == slow_base(r.text or "")


def test_crf_gradient_is_the_slope_of_the_loss():
    t = pii.Tagger(1)
    t.p = {k: x.astype(np.float64) for k, x in t.p.items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, pii.N_CHARS, (2, 5)), r.integers(0, pii.TAGS, (2, 5))
    _, g = t.gradient(ids, tags)
    for k in ("t", "o", "fh", "bx", "fb"):
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        eps, keep = 1e-2, t.p[k][at]
        t.p[k][at] = keep + eps
        up = t.gradient(ids, tags)[0]
        t.p[k][at] = keep - eps
        down = t.gradient(ids, tags)[0]
        t.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-3)


def test_tagger_learns_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tagger = pii.train_tagger(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 2 = 1").collect() if r.text]
    gold = {(i, k, *s) for i, t in enumerate(texts) for k, spans in pii.base_spans(t).items() for s in spans}
    got = {(i, *s) for i, spans in enumerate(pii.tagged_spans(texts, tagger)) for s in spans}
    assert len(gold & got) >= 0.5 * len(gold)  # from fewer than a hundred windows


# ---- toxicity and language -------------------------------------------------------------------


def test_viterbi_reads_through_the_noise():
    corpus = " ".join(["the stupid rabbit is an idiot and a harmless animal"] * 50)
    model = toxicity.CharModel(toxicity.trigram_counts(corpus))
    assert toxicity.decode("1d10t", model) == "idiot"
    assert toxicity.decode("s.t.u.p.i.d", model) == "stupid"
    assert toxicity.decode("idiooot", model) == "idiot"
    assert toxicity.restore("an 1d10t!", model, {}).split()[0] == "an"


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    both = sum(r.predicted and r.toxic for r in scored)
    assert 2 * both / (sum(r.predicted for r in scored) + sum(r.toxic for r in scored)) >= 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 100")
    got = language_id.identify(None, docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 5 != 0").select("lang", "text"))
    right = got.join(docs.select("doc_id", F.col("lang").alias("said")), "doc_id").select(F.avg((F.col("lang") == F.col("said")).cast("int"))).first()[0]
    assert right >= 0.9


def test_tagger_finds_rewritten_spans_that_the_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    tagger = pii.train_tagger(docs.filter("doc_id % 2 = 0"))
    held = [w for w in pii.training_windows(docs.filter("doc_id % 2 = 1")) if any(w[1])]
    rewritten = [pii.varied(*w, random.Random(i)) for i, w in enumerate(held)]

    def spans(tags):
        starts = [i for i, t in enumerate(tags) if t % 2]
        ends = [next((j for j in range(i + 1, len(tags)) if tags[j] != tags[i] + 1), len(tags)) for i in starts]
        return {(pii.KINDS[tags[i] // 2], i, e) for i, e in zip(starts, ends) if e < len(tags)}

    gold = {(n, *s) for n, (_, tags) in enumerate(rewritten) for s in spans(tags)}
    base = {(n, k, *s) for n, (w, _) in enumerate(rewritten) for k, found in pii.base_spans(w).items() for s in found}
    got = {(n, *s) for n, found in enumerate(pii.tagged_spans([w for w, _ in rewritten], tagger)) for s in found}
    assert len(gold) > 100 and len(base & gold) < 0.1 * len(gold)
    assert len(gold & got) >= 0.8 * len(gold) and len(gold & got) >= 0.8 * len(got)


def test_training_windows_are_distinct_and_bounded(spark):
    docs = spark.createDataFrame([(i, f"call +49 30 {1000000 + i % 7} now") for i in range(300)], "doc_id long, text string").repartition(3)
    assert len(pii.training_windows(docs)) == 7
    one = pii.training_windows(docs, max_train=3)
    assert len(one) == 3 and one == pii.training_windows(docs.repartition(2), max_train=3)
