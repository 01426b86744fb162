"""Language identification by Bayesian evidence fusion.

For every item (a page, or a document) the posterior of language l is

    text likelihood ** temper  x  P(declared | l)  x  P(suffix | l)  x  P(l | host)

* The text likelihood is a character trigram model per language, counted over all ``documents`` with a
  language. Trigrams are hashed to 2**16 places; the log likelihood is a mean per character, scaled,
  as neighbouring trigrams are far from independent.
* Declared is the markup language (<html lang>, anywhere in the page but in comments and scripts), suffix the top-level domain with a leading two-letter
  path segment. Their tables are soft counts of the text posteriors, grouped over all items.
* Host priors are smoothed hierarchically: host to registered domain to suffix to corpus, each level
  adding ``KAPPA`` pseudo-items of the one above.

Defined cases: null or empty text leaves the other evidence; null url, host or markup is a value of
its own; without any language in ``documents`` the result has null languages; repeated rows count and
return each; very long texts are counted whole; of equally probable languages the first by name is
taken; extra columns, whatever their names, don't matter; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .html_text import read_page

PLACES = 1 << 16
KAPPA = 5.0
#: Trigrams a text counts for at most in the exponent, and the weight of each.
EFFECTIVE, TEMPER = 60.0, 0.5


def places(text: str) -> np.ndarray:
    """Hashed places of the trigrams of the lower-cased text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) & np.uint32(PLACES - 1)


def trigram_table(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language), places x languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    sums.setdefault(lang, np.zeros(PLACES, np.int64))
                    sums[lang] += np.bincount(places(text), minlength=PLACES) if len(text) > 4000 else 0
                    if len(text) <= 4000:
                        np.add.at(sums[lang], places(text), 1)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(s[at])], ["lang", "place", "n"])

    known = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = known.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = [(r.lang, r.place, r.n) for r in counts.toLocalIterator()]  # languages x PLACES at most
    langs = sorted({r[0] for r in rows})
    table = np.full((PLACES, len(langs)), 0.05)
    for lang, place, n in rows:
        table[place, langs.index(lang)] += n
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _likelihoods(items: DataFrame, langs: list[str], table: np.ndarray, markup: bool) -> DataFrame:
    """Adds declared and one log likelihood column per language, from ``body`` (html if ``markup``)."""
    held = items.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, out = [], np.zeros((b.num_rows, len(langs)))
            for i, body in enumerate(b.column(4).to_pylist()):
                body = body or ""
                blocks, declared = read_page(body) if markup else ([], None)
                said.append(declared)
                text = " ".join(x[0] for x in blocks) if markup else body
                if text.strip():
                    at = places(text)
                    out[i] = held.value[at].mean(axis=0) * min(len(at) * TEMPER, EFFECTIVE)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(said, pa.string()), *(pa.array(c) for c in out.T)], ["doc_id", "page_id", "url", "host", "declared", *(f"ll{i}" for i in range(len(langs)))])

    fields = "".join(f", ll{i} double" for i in range(len(langs)))
    return items.select("doc_id", "page_id", "url", "host", "body").mapInArrow(run, f"doc_id long, page_id long, url string, host string, declared string{fields}")


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    e = [F.exp(x - top) for x in logs]
    s = _total(e)
    return [x / s for x in e]


def identify(pages: DataFrame | None, docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, page_id, host, suffix, declared, text_lang, lang, confidence) of every page and document."""
    langs, table = trigram_table(train)
    none = F.lit(None).cast("long")
    own = docs.select(F.col("doc_id").cast("long"), none.alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("body"))
    parts = [_likelihoods(own, langs, table, False)]
    if pages is not None:
        url = F.coalesce(F.col("url").cast("string"), F.lit(""))
        host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
        parts.append(_likelihoods(pages.select(none.alias("doc_id"), F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string").alias("body")), langs, table, True))
    items = reduce(DataFrame.unionByName, parts)
    host = F.coalesce("host", F.lit(""))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    suffix = F.concat_ws("/", F.regexp_extract(host, r"\.([^.]+)$", 1), path)
    items = items.select("doc_id", "page_id", host.alias("host"), F.when(domain == "", host).otherwise(domain).alias("domain"), suffix.alias("suffix"), F.coalesce("declared", F.lit("")).alias("declared"), *[f"ll{i}" for i in range(len(langs))])
    if not langs:
        null = F.lit(None).cast("string")
        return items.select("doc_id", "page_id", "host", "suffix", "declared", null.alias("text_lang"), null.alias("lang"), F.lit(0.0).alias("confidence"))
    items = scratch(items, "langid")
    n = range(len(langs))
    soft = items.select("*", *[p.alias(f"p{i}") for i, p in zip(n, _softmax([F.col(f"ll{i}") for i in n]), strict=True)])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in n]
    base = soft.agg(*[F.sum(f"p{i}") for i in n]).first()  # one row of language totals
    total = sum(x or 0 for x in base) or 1.0
    prior = [((x or 0) + 1.0) / (total + len(langs)) for x in base]

    def evidence(key: str, name: str) -> DataFrame:
        """log P(key | language) from soft counts; one row per distinct value."""
        return soft.groupBy(key).agg(*sums).select(key, *[F.log((F.col(f"p{i}") + F.lit(prior[i])) / ((base[i] or 0) + 1.0)).alias(f"{name}{i}") for i in n])

    def smoothed(counts: DataFrame, above: list[Column], out: str) -> list[Column]:
        whole = _total([F.col(f"p{i}") for i in n])
        return [((F.col(f"p{i}") + KAPPA * above[i]) / (whole + KAPPA)).alias(f"{out}{i}") for i in n]

    by_host = soft.groupBy("host", "domain").agg(*sums)
    by_tld = soft.groupBy(F.regexp_extract("host", r"\.([^.]+)$", 1).alias("tld")).agg(*sums)
    tlds = by_tld.select("tld", *smoothed(by_tld, [F.lit(p) for p in prior], "t"))
    by_domain = by_host.groupBy("domain").agg(*sums).withColumn("tld", F.regexp_extract("domain", r"\.([^.]+)$", 1)).join(tlds, "tld")
    domains = by_domain.select("domain", *smoothed(by_domain, [F.col(f"t{i}") for i in n], "d"))
    hosts = by_host.join(domains, "domain")
    hosts = hosts.select("host", *smoothed(hosts, [F.col(f"d{i}") for i in n], "h"))
    fused = items.join(evidence("declared", "e"), "declared").join(evidence("suffix", "s"), "suffix").join(hosts, "host")
    post = _softmax([F.col(f"ll{i}") + F.col(f"e{i}") + F.col(f"s{i}") + F.log(F.col(f"h{i}")) for i in n])
    pick = lambda cols: F.array_max(F.array(*[F.struct(c.alias("p"), F.lit(-i).alias("i")) for i, c in zip(n, cols, strict=True)]))
    name = lambda best: F.element_at(F.array(*[F.lit(x) for x in langs]), 1 - best["i"])
    blank = _total([F.abs(f"ll{i}") for i in n]) == 0
    out = fused.withColumns({"_b": pick(post), "_t": pick([F.col(f"ll{i}") for i in n])})
    return out.select("doc_id", "page_id", "host", "suffix", "declared", F.when(~blank, name(F.col("_t"))).alias("text_lang"), name(F.col("_b")).alias("lang"), F.col("_b.p").alias("confidence"))
