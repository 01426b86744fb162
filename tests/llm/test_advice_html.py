"""Declared languages and templates of odd pages."""

import pytest

from chronoterra.llm import html_text, language_id
from chronoterra.llm.html_text import read_page

PAGES = {
    "<!-- " + "licence " * 1000 + "--><html lang='de'><body><p>a": "de",
    " " * 5000 + "<HTML class=x LANG=FR-ca><p>a": "fr",
    "<html data-x='" + "y" * 5000 + "' lang=\"it\"><p>a": "it",
    "<!-- <html lang=en> --><html lang=nl><p>a": "nl",
    "<script>'<html lang=en>'</script><html xml:lang='es'><p>a": "es",
    "<html><p>a</p></html><html lang=pt>": "pt",
    "<html lang=sv": "sv",
    "<html lang=''><p>a": None,
    "<p>a": None,
    "": None,
}


@pytest.mark.parametrize("page", PAGES)
def test_declared_language_is_found_anywhere(page):
    assert read_page(page)[1] == PAGES[page]


def test_late_declaration_reaches_the_query(spark):
    docs = spark.createDataFrame([(1, "the word and the word", "en", "w"), (2, "das Wort und das Wort", "de", "w")], "doc_id long, text string, lang string, source string")
    page = next(iter(PAGES))
    pages = spark.createDataFrame([(1, "http://a.example/x", page)], "page_id long, url string, html string")
    got = language_id.identify(pages, docs.select("doc_id", "source", "text"), docs.select("lang", "text"))
    assert [r.declared for r in got.filter("page_id = 1").collect()] == ["de"]


@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_copies_keep_their_content_and_templates_go(spark, tag):
    page = lambda own, foot: f"<html><body><{tag}><h1>{own}</h1><div><p>list of {own}</p></div><div><p>same block</p></div></{tag}><div><p>{foot}</p></div></body></html>"
    rows = [(i, "http://a.example/copy", page("copy", "end")) for i in range(8)]
    rows += [(10 + i, "http://a.example/x", page(f"page {i}", "end")) for i in range(6)]
    rows += [(20 + i, "http://b.example/x", page("copy", "end")) for i in range(8)]
    got = {r.page_id: r.text.split("\n") for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == ["copy", "list of copy"]
        assert got[20 + i][:2] == ["copy", "list of copy"]  # all pages of the host are copies
    for i in range(6):
        assert got[10 + i] == [f"page {i}", f"list of page {i}"]
