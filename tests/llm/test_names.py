"""Columns with signs in their names, odd rows and empty tables in every operator and stage."""

import pytest

import corpus_pipeline
from chronoterra.llm import collocations, decontamination, fill_in_middle, language_id, line_dedup, mixing, near_copies, pii, simhash, substring_dedup, token_files, toxicity

from ..oracle import SMALL

LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, "a plain text of some words\nshared line", "en", "w", 1), (1, "a plain text of some words\nshared line", "en", "w", 1), (2, None, None, None, None), (3, "", "", "", 0), (None, "no id here but text", None, "w", 3), (4, LONG, "la", "w", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c d` int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("b1", "some other words that nobody has")], "item_id string, text string")


KEEPING = {
    "line_dedup": lambda d, lab, it: line_dedup.drop_boilerplate(d),
    "mixing": lambda d, lab, it: mixing.mixing_probabilities(d),
    "toxicity": lambda d, lab, it: toxicity.toxicity_scores(d, d, lab),
    "decontamination": lambda d, lab, it: decontamination.drop_contaminated(d, it),
    "fill_in_middle": lambda d, lab, it: fill_in_middle.restore(fill_in_middle.fill_in_middle(d)),
}
OTHERS = {
    "pii": lambda d, lab, it: pii.find_pii(d),
    "substring_dedup": lambda d, lab, it: substring_dedup.drop_repeats(d),
    "contamination": lambda d, lab, it: decontamination.contamination(d, it),
    "simhash": lambda d, lab, it: simhash.simhash_groups(d),
    "signatures": lambda d, lab, it: near_copies.signatures(d),
    "language_id": lambda d, lab, it: language_id.identify(None, d, d),
}


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_columns_pass_whatever_their_names(docs, labels, items, name):
    rows = KEEPING[name](docs, labels, items).collect()
    assert len(rows) == len(ROWS) and {(r["a.b"], r["c d"]) for r in rows} == {("x", 7)}
    told = {(r.doc_id, r.text if name != "line_dedup" or not r.text else None) for r in rows if "text" in r}
    if name in ("mixing", "toxicity", "decontamination"):
        assert told == {(i, t) for i, t, *_ in ROWS}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_names_do_not_matter(docs, labels, items, name):
    assert OTHERS[name](docs, labels, items).count() == len(ROWS)


def test_values_of_odd_rows(docs, labels, items):
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, docs, labels).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[2] == scores[3]
    lines = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert lines[2] == (0, 0, None) and lines[3] == (1, 0, "") and lines[4] == (1, 0, LONG)
    groups = {r.doc_id: (r.fp, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert groups[2] == groups[3] == (0, 2) and groups[1][1] == 1
    mixed = {r.doc_id: (r.topic, r.n_tokens) for r in mixing.mixing_probabilities(docs).collect()}
    assert mixed[2] == mixed[3] == ("empty", 0) and mixed[4][1] == 60_000
    found = {r.doc_id: r.base for r in pii.find_pii(docs).collect()}
    assert not found[2] and not found[3] and not found[4]
    parts = {r.doc_id: (r.n_bytes, r.n_removed) for r in substring_dedup.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()}
    assert parts[2][1] == parts[3][1] == 0


def test_stages_bear_odd_tables(spark, docs):
    for table in (docs, docs.filter("false")):
        own = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, SMALL)
            assert own.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, own, SMALL)
        assert last.columns[: len(docs.columns)] == docs.columns
        assert {r["a.b"] for r in last.collect()} <= {"x"}
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SMALL).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 4]  # one of the equal rows, one without words


def test_new_operators_on_odd_tables(docs):
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    assert token_files.token_files(docs, public.path("word_bpe_49k.json")).count() == len(ROWS)
    assert [(r.phrase, r.a) for r in collocations.collocations(docs).filter("lang = 'la'").collect()] == [("lorem ipsum dolor", 20_000), ("dolor lorem ipsum", 19_999), ("ipsum dolor lorem", 19_999)]
