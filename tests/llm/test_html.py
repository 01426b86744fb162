"""Main text of pages: HTML's own rules, templates against a plain count, and long odd pages."""

import random
import time
from collections import defaultdict

import pytest

from chronoterra.llm import html_text
from chronoterra.llm.html_text import read_page

SCHEMA = "page_id long, url string, html string"

CASES = {
    "<p>Hi</p><button>Share</button><label>Your name</label><select><option>x<option>y</select>": "Hi",
    "<p>a <input value=b><textarea>c</textarea>d": "a d",
    "super<wbr>cali <img src=x>fragi<br>listic": "supercali fragi listic",
    '<div id="content" class="main has-sidebar"><h1 class="post-header">T</h1><section class="legal"><p>a</section></div>': "T\na",
    '<p>a <span class="advert">buy <span>now</span></span>b <a class="share">s</a>c': "a b c",
    "<p><math><mi>x</mi></math> <object>old</object>": "x old",
    "<div>a<nav>b<p>c</nav>d</div>e<script>if(a<b)</script>f<!-- x -->g": "a\nd\nefg",
    "1 < 3 & 5 > 2 &lt;b&gt; &copy; &#233;": "1 < 3 & 5 > 2 <b> © é",
    "<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><p>one<p>two": "a\nb\nc\nx\ny\none\ntwo",
    "<html><head><title>t</title><meta x><body>hi": "hi",
    "a</p>b</ >c<a href='x>y'>z</a>": "abcz",
    "<p>kept <a": "kept",
    "<article><header><h1>T</h1></header><p>x</article><header>h</header>": "T\nx",
    '<div role="navigation">n</div><div hidden>h</div><p style="display: none">s</p><p>t': "t",
    '<article class="comments"><p>c</article><p>t': "t",
}


@pytest.mark.parametrize("page", CASES)
def test_page(page):
    assert "\n".join(b[0] for b in read_page(page)[0]) == CASES[page]


@pytest.mark.parametrize("part", ["<a <b ", "<div>", "<", '<a b="', "</", "<!--", "<a b='c>", "<ul><li>x", "<p>&", "<td>"])
def test_long_odd_pages_take_linear_time(part):
    took = []
    for n in (250_000, 1_000_000):
        start = time.perf_counter()
        read_page(part * (n // len(part)))
        took.append(time.perf_counter() - start)
    assert took[1] < max(1.0, 12 * took[0])  # four times the page; 16 would be quadratic


def site(r, host, n):
    """Pages whose articles are theirs alone, with a bar, a notice within the article and a closing line that many share."""
    bar, notice, rare = (" ".join(r.choice("abcdefg") * 4 for _ in range(6)) for _ in range(3))
    for i in range(n):
        own = [" ".join(str(r.randrange(10_000)) for _ in range(8)) for _ in range(3)]
        inside = f"<p>{notice}</p>" if i % 10 < 8 else ""
        odd = f"<div><p>{rare}</p></div>" if i % 10 == 0 else ""
        yield f"http://{host}/{i}", f"<body><div><p>{bar}</p></div><section><h1>{own[0]}</h1><p>{own[1]}</p>{inside}</section>{odd}<div><p>{own[2]}</p></div>", own


def plain_texts(pages):
    """The same rule by dictionaries: deletes what recurs, then joins what is left."""
    parsed = [(url.split("/")[2], read_page(page)[0]) for url, page in pages]
    content = lambda blocks: [b for b in blocks if b[3]] or [b for b in blocks if b[4]] or blocks
    seen, contents = defaultdict(set), defaultdict(set)
    for host, blocks in parsed:
        key = tuple(b[0] for b in content(blocks))
        contents[host].add(key)
        for b in blocks:
            for share, hashes in ((html_text.SHARE, b[1]), (html_text.LEAF_SHARE, b[2])):
                for h in hashes:
                    seen[host, h, share].add(key)
    gone = {(host, h) for (host, h, share), keys in seen.items() if len(keys) >= max(html_text.MIN_PAGES, share * len(contents[host]))}
    return ["\n".join(b[0] for b in content([b for b in blocks if not {(host, h) for h in b[1] + b[2]} & gone])) for host, blocks in parsed]


def test_templates_against_a_plain_count(spark):
    r = random.Random(3)
    made = [*site(r, "a.example", 40), *site(r, "b.example", 30), *site(r, "c.example", 4)]
    pages = [(url, page) for url, page, _ in made]
    rows = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(pages)], SCHEMA)
    got = [x.text for x in html_text.main_text(rows).orderBy("page_id").collect()]
    assert got == plain_texts(pages)
    assert all(got[i].split("\n") == (own if u.split("/")[-1][-1:] != "0" else [*own[:2], *got[i].split("\n")[2:3], own[2]]) for i, (u, _, own) in enumerate(made[:70]))
    kept = [x.text for x in html_text.main_text(rows, share=99, leaf_share=99).orderBy("page_id").collect()]
    assert sum(a != b for a, b in zip(got, kept)) >= 70  # all of both sites with a template


def test_a_paragraph_of_an_article_goes_only_if_most_pages_have_it(spark):
    page = lambda i, extra: f"<article><h1>own {i}</h1><p>text {i}</p>{extra}</article>"
    rows = [(i, "http://a.example/x", page(i, "<p>in few</p>" if i < 4 else "<p>in most</p>")) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"own {i}\ntext {i}" + ("\nin few" if i < 4 else "") for i in range(12))
