"""Language fusion, deobfuscation and the pipeline against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from chronoterra.llm import decontamination, html_text, language_id, line_dedup, mixing, toxicity

from ..oracle import SMALL
from .test_near_copies import near_groups


# ---- language --------------------------------------------------------------------------------


def plain_posteriors(pages, docs, train):
    """identify() by dictionaries over lists of rows."""
    langs = sorted({lang for lang, t in train if lang and t})
    table = np.full((language_id.PLACES, len(langs)), 0.05)
    for lang, t in train:
        if lang and t is not None:
            for p in language_id.places(t):
                table[p, langs.index(lang)] += 1
    table = np.log(table / table.sum(axis=0))
    items = [("d", i, source or "", "", "", t or "") for i, source, t in docs]
    for i, url, page in pages:
        blocks, declared = html_text.read_page(page)
        host = re.match(r"[a-z]+://([^/:?#]+)", url or "")
        path = re.match(r"[a-z]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", url or "")
        items.append(("p", i, host[1].lower() if host else "", path[1].lower() if path else "", declared or "", " ".join(b[0] for b in blocks)))
    soft = lambda x: (e := np.exp(x - x.max())) / e.sum()
    rows = []
    for kind, i, host, path, declared, text in items:
        at = language_id.places(text) if text.strip() else []
        ll = table[at].mean(axis=0) * min(len(at) * language_id.TEMPER, language_id.EFFECTIVE) if len(at) else np.zeros(len(langs))
        tld = (re.search(r"\.([^.]+)$", host) or ["", ""])[1]
        domain = (re.search(r"([^.]+\.[^.]+)$", host) or ["", host])[1]
        rows.append((kind, i, host, domain, tld, f"{tld}/{path}", declared, ll, soft(ll)))
    base = sum(r[8] for r in rows)
    prior = (base + 1) / (base.sum() + len(langs))
    total = lambda at: {k: sum(r[8] for r in rows if r[at] == k) for k in {r[at] for r in rows}}
    by = {at: total(at) for at in range(2, 7)}
    up = lambda own, above: (own + language_id.KAPPA * above) / (own.sum() + language_id.KAPPA)
    out = {}
    for kind, i, host, domain, tld, suffix, declared, ll, _ in rows:
        p_host = up(by[2][host], up(by[3][domain], up(by[4][tld], prior)))
        likely = lambda at, k: np.log((by[at][k] + prior) / (base + 1))
        post = soft(ll + likely(6, declared) + likely(5, suffix) + np.log(p_host))
        out[kind, i] = langs[int(post.argmax())], float(post.max())
    return out


def test_language_fusion_against_plain_python(spark):
    r = random.Random(4)
    words = {"en": "the and of with from this that".split(), "de": "der und das mit von nicht ist".split(), "fr": "le et la avec dans que est".split()}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    train = [(lang, say(lang, 30)) for lang in words for _ in range(4)] + [(None, "x"), ("en", None)]
    docs = [(i, r.choice(["src0", "src1", None]), say(r.choice([*words]), r.randrange(1, 8)) if i % 9 else None) for i in range(40)]
    hosts = [("www.a.de", "de"), ("b.fr", "fr"), ("blog.c.com", "en"), ("shop.c.com", "fr"), ("odd", "en")]
    pages = []
    for i in range(60):
        host, lang = r.choice(hosts)
        tag = f' lang="{lang}-XX"' if r.random() < 0.5 else ""
        body = say(lang if r.random() < 0.9 else "en", r.randrange(1, 5)) if i % 7 else ""
        pages.append((i, f"http://{host}/{r.choice(['de', 'fr', 'x'])}/{i}" if i % 11 else None, f"<html{tag}><body><p>{body}" if i % 13 else None))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = language_id.identify(frame(pages, "page_id long, url string, html string"), frame(docs, "doc_id long, source string, text string"), frame(train, "lang string, text string")).collect()
    want = plain_posteriors(pages, docs, train)
    assert len(got) == len(want)
    for x in got:
        lang, p = want["d", x.doc_id] if x.doc_id is not None else want["p", x.page_id]
        assert x.confidence == pytest.approx(p, rel=1e-4)
        assert x.lang == lang or p < 0.5


# ---- deobfuscation ---------------------------------------------------------------------------


def every_reading(stretch, model):
    """The cost of each reading, by trying all ways through the lattice."""
    run = {i for i in range(1, len(stretch)) if stretch[i] == stretch[i - 1] and stretch[i].isalpha() and any(stretch[j : j + 3] == stretch[i] * 3 for j in range(max(0, i - 2), i + 1))}
    ways = []
    for i, ch in enumerate(stretch):
        t = toxicity
        if ch.isalpha():
            ways.append([(ch, 0.0)] + ([("", t.REPEAT_COST)] if i in run else []))
        elif ch in t.SEPARATORS:
            ways.append([("", t.JOIN_COST), (" ", t.GAP_COST), *((x, t.STAR_COST) for x in t.IMITATES.get(ch, ""))])
        else:
            ways.append([*((x, t.LEET_COST) for x in t.IMITATES.get(ch, "")), (" ", 2 * t.GAP_COST)] + ([] if ch.isdigit() else [("", t.DROP_COST)]))
    best = {}
    for path in product(*ways):
        a, b, cost, text = " ", " ", 0.0, ""
        for x, price in path:
            cost += price
            if x and not (x == " " and b == " "):
                cost += model.cost(a, b, x)
                a, b, text = b, x, text + x
        cost += 0 if b == " " else model.cost(a, b, " ")
        best[text.strip()] = min(cost, best.get(text.strip(), math.inf))
    return best


@pytest.mark.parametrize("stretch", ["1d10t", "s.t.u", "st*p", "h4llo", "aaab", "sooo b4d", "$h!t", "a-b 1", "h.0.p.3", "n000"])
def test_viterbi_finds_the_cheapest_of_all_readings(stretch):
    model = toxicity.CharModel(toxicity.trigram_counts(" ".join(["the stupid rabbit is an idiot and a harmless animal so bad hello stop"] * 30)))
    readings = every_reading(stretch, model)
    assert readings[toxicity.decode(stretch, model)] == pytest.approx(min(readings.values()))


# ---- pipeline --------------------------------------------------------------------------------


def plain_line_dedup(docs):
    pages, on = Counter(d["source"] or "" for d in docs), defaultdict(int)
    for d in docs:
        for line in set((d["text"] or "").split("\n")) if d["text"] is not None else ():
            on[d["source"] or "", line] += bool(line.strip(" "))
    drop = {k for k, n in on.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    for d in docs:
        if d["text"] is not None:
            text = "\n".join(x for x in d["text"].split("\n") if (d["source"] or "", x) not in drop)
            yield d | {"text": text, "n_chars": len(text)}
        else:
            yield d | {"n_chars": None}


def plain_near_dedup(docs):
    best = {}
    signed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)  # noqa: E731  any order among texts of one id will do
    for d, k in zip(docs, near_groups([d["text"] for d in docs]), strict=True):
        rank = (d["doc_id"] is None, d["doc_id"] or 0, signed(d["text"]))
        if k not in best or rank < best[k][0]:
            best[k] = rank, d
    return [d for _, d in best.values()]


def plain_decontamination(docs, items):
    windows, whole = set(), set()
    for item, text in items:
        w = tuple(decontamination.words((text or "").encode()))
        if item is None or not w:
            continue
        if len(w) < decontamination.FILTER_SHORTEST:
            whole.add(w)
        else:
            n = min(10, len(w))
            windows |= {w[i : i + n] for i in range(len(w) - n + 1)}
    sizes = {len(w) for w in windows}
    for d in docs:
        w = tuple(decontamination.words((d["text"] or "").encode()))
        if w not in whole and not any(w[i : i + n] in windows for n in sizes for i in range(len(w) - n + 1)):
            yield d


def test_pipeline_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(9001, "Hello there\n" * 3, "en", "odd", 5), (9001, "another text of its own " * 9, "en", None, 5), (None, "no id but a text of some length", None, "odd", 1), (9002, None, "en", "odd", None), (9003, "", "en", "odd", 0)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.filter("doc_id = 3"))
    frame, at = docs, 0
    rows = [r.asDict() for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    key = lambda d: (d["doc_id"] is None, d["doc_id"] or 0, d["text"] or "", d["n_chars"] or 0)
    for name, plain in (("line_dedup", lambda d: [*plain_line_dedup(d)]), ("simhash_near_dedup", plain_near_dedup), ("decontamination", lambda d: [*plain_decontamination(d, items)])):
        at += 1
        assert corpus_pipeline.STAGES[at][0] == name
        frame = corpus_pipeline.scratch(corpus_pipeline.STAGES[at][1](spark, frame, SMALL), name)
        rows = plain(rows)
        assert sorted((key(r.asDict()) for r in frame.collect())) == sorted(map(key, rows))
    last = corpus_pipeline.STAGES[4][1](spark, frame, SMALL)
    want = mixing.mixing_probabilities(spark.createDataFrame(frame.collect(), frame.schema)).filter("sampled")
    assert sorted((r.doc_id or -1, r.copies) for r in last.collect()) == sorted((r.doc_id or -1, r.copies) for r in want.collect())
    toxic = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    scores = toxicity.toxicity_scores(docs, docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert sorted(map(str, toxic.collect())) == sorted(str(r) for r in scores.filter("score < 0.5").select(docs.columns).collect())
