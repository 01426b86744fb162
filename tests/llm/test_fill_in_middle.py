"""The fill-in-middle kernel against a plain version, and its way back."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoterra.llm import fill_in_middle as fim

texts = st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="<PSM>aé語😀 \n", max_size=20)), max_size=12)


def numbers(doc_id, seed="1"):
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]


def plain(text, doc_id):
    t, (h1, h2, h3, h4) = text or "", numbers(doc_id)
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(0, 10**6))
def test_kernel_equals_the_plain_version(rows, first):
    ids = range(first, first + len(rows))
    hashes = [fim.np.array([numbers(i)[k] for i in ids], fim.np.int64) for k in range(4)]
    got = fim.transform(pa.array(rows, pa.string()), hashes)
    assert [tuple(x) for x in zip(*(c.to_pylist() for c in got), strict=True)] == [plain(t, i) for t, i in zip(rows, ids, strict=True)]
    assert fim.rebuild(got[4], got[1]).to_pylist() == [t or "" for t in rows]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_word_units_are_cut_before_white_space(rows):
    import re

    raw, at = fim._bytes_of(pa.array(rows, pa.string()))
    n = fim.unit_sums(raw, at, "words")[2].tolist()
    units = [re.findall(r"[ \t-\r]+[^ \t-\r]*|^[^ \t-\r]+", t or "") for t in rows]
    assert n == [len(u) for u in units]
    for row, u in zip(rows, units, strict=True):
        assert "".join(u) == (row or "")


def test_slices_of_a_batch(spark):
    rows = pa.array(["abc", None, "déf", "語語語語", ""]).slice(1, 3)
    raw, at = fim._bytes_of(rows)
    assert fim.unit_sums(raw, at)[2].tolist() == [0, 3, 4]


@pytest.mark.parametrize("unit", ["chars", "words"])
def test_odd_rows_and_columns(spark, unit):
    long = "lorem ipsum <dolor> é " * 100_000
    data = [(1, "a <P> b"), (2, None), (3, ""), (None, "no id here"), (4, long), (4, long), (5, "語" * 50)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 7) for r in data], "doc_id long, text string, `a.b` string, n long, c0 string, h0 int")
    made = fim.fill_in_middle(docs, unit=unit)
    assert made.columns == ["doc_id", "a.b", "c0", "h0", "n", "form", "prefix_units", "middle_units", "output"]
    back = fim.restore(made).select("doc_id", "text", "`a.b`", "c0", "h0", "n", "form").collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in data)
    assert {(r["a.b"], r.c0, r.h0) for r in back} == {("x", "y", 7)}
    by_id = {r.doc_id: r for r in back}
    assert by_id[2].n == by_id[3].n == 0 and {by_id[i].form for i in (1, 2, 3)} == {"plain"}
    if unit == "chars":
        assert {(r.doc_id, r.output) for r in made.collect()} == {(i, plain(t, i)[4]) for i, t in data}
    assert fim.restore(fim.fill_in_middle(docs.filter("false"))).collect() == []


def test_other_marks_and_seed(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some length <P>") for i in range(200)], "doc_id long, text string")
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = fim.fill_in_middle(docs, marks=marks, seed="other")
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    back = {r.doc_id: r.text for r in fim.restore(made, marks=marks).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
