"""Queries with SQL against it at sf0.001, and the odd cases every operator has to bear."""

import pytest

import corpus_pipeline
from chronoterra.llm import decontamination, html_text, language_id, line_dedup, mixing, pii, queries, simhash, substring_dedup, topk, toxicity

from ..oracle import SMALL, assert_same
from .test_near_copies import near_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _s string, _p string, h long, k long, score string, keys string, host string"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    clash = ("s", "p", 1, 2, "sc", "ks", "ho")
    data = [
        (1, "a plain text of some words\nshared line", "en", "w", 1),
        (1, "a plain text of some words\nshared line", "en", "w", 1),
        (2, None, None, None, None),
        (3, "", "", "", 0),
        (None, "no id here but text\nshared line", None, "w", 3),
        (4, LONG, "la", "w", 4),
        (5, " \n\t ", "en", None, 5),
    ]
    return spark.createDataFrame([r + clash for r in data], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("b1", "a plain text of some"), ("b2", None), (None, "no id here but text"), ("b1", "a plain text of some")], "item_id string, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name])


OPERATORS = {
    "line_dedup": lambda d, lab, it: line_dedup.drop_boilerplate(d),
    "language_id": lambda d, lab, it: language_id.identify(None, d, d),
    "mixing": lambda d, lab, it: mixing.mixing_probabilities(d),
    "pii": lambda d, lab, it: pii.find_pii(d),
    "toxicity": lambda d, lab, it: toxicity.toxicity_scores(d, d, lab),
    "substring_dedup": lambda d, lab, it: substring_dedup.drop_repeats(d),
    "decontamination": lambda d, lab, it: decontamination.contamination(d, it),
    "simhash": lambda d, lab, it: simhash.simhash_groups(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_keep_their_number(odd, labels, items, name):
    out = OPERATORS[name](odd, labels, items)
    assert out.count() == 7


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_give_empty_tables(odd, labels, items, name):
    none = odd.filter("false")
    assert OPERATORS[name](none, labels.filter("false"), items.filter("false")).collect() == []


def test_clashing_columns_pass_unchanged(odd):
    for out in (mixing.mixing_probabilities(odd), line_dedup.drop_boilerplate(odd)):
        assert {(r._s, r._p, r.h, r.k, r.keys, r.host) for r in out.collect()} == {("s", "p", 1, 2, "ks", "ho")}


def test_odd_rows_of_decontamination(odd, items):
    got = {r.doc_id: r for r in decontamination.contamination(odd, items).collect()}
    assert got[1].n_hit == 5 and got[1].n_items == 1 and got[1].contaminated
    assert got[2].n_words == 0 and not got[2].contaminated and not got[None].contaminated and got[4].n_words == 60_000


def test_odd_pages(spark):
    data = [(1, None, None), (2, "http://a.example/x", ""), (3, "http://a.example/y", "<article><p>One &amp; two<p>three"), (3, "http://a.example/y", "<article><p>One &amp; two<p>three"), (4, "::", "<div"), (None, "http://a.example/z", "plain  text")]
    got = html_text.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "plain text", 10), (1, "", 0), (2, "", 0), (3, "One & two\nthree", 15), (3, "One & two\nthree", 15), (4, "", 0)]


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf")]), (7, [0.5]), (None, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(v, v.filter("vec_id in (0, 3)"), k=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    assert topk.exact_top_k(v.filter("false"), v).collect() == []


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.scratch(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        assert 0.5 * before <= docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    want = mixing.mixing_probabilities(docs).filter("sampled").select("doc_id")
    assert last.select("doc_id").exceptAll(want).count() == 0 == want.exceptAll(last.select("doc_id")).count()
    # what the earlier stages decide holds for their results: nothing left to link or to find
    texts = [r.text for r in docs.collect()]
    assert len(set(near_groups(texts))) == len(texts)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontamination.contamination(docs, bench, shortest=decontamination.FILTER_SHORTEST).filter("contaminated").count() == 0
