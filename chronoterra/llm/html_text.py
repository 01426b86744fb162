"""HTML main-text extraction with site template removal.

A page is read once, from left to right, into an element tree with implied end tags. What HTML itself
marks as no content is left out: menus, footers, forms, controls, scripts and the like by tag, role or
hiding, and elements whose class or id is exactly the word for an advert, comment, notice or sidebar.
Every other subtree that holds text gets a hash. Spark counts per host with how many contents a hash
occurs, and subtrees that recur are template and are deleted: containers and all outside an article
from ``share`` of the host's contents on, single paragraphs, headings and items of an article from
``leaf_share`` on (at least ``min_pages`` each). Text that no other page has is never template.

A page's content is the text of its article (else main part, else all of it); copies of it count once,
so they make nothing a template. The article's own element is never template.

Defined cases: null or empty html gives '' and 0; unclosed or stray tags are closed as browsers do; a
page that ends within a tag ends before it; without an article, the main element and then the body
serves; null url is a host of its own (''); repeated rows are one content and return each; columns
besides page_id, url and html, whatever their names, don't matter; very long pages are read whole, in
time linear in their length (elements nest 64 deep, deeper ones join their parent); an empty table
gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

SHARE, LEAF_SHARE = 0.2, 0.5
MIN_PAGES = 5
DEEPEST = 64
#: Template hashes up to which the per-host lists are broadcast (8 bytes each); beyond it the join shuffles on the host and Spark splits hot hosts.
BROADCAST_HASHES = 200_000

#: Fixed values of the HTML standard: elements without end tag, with text only, that make blocks, of text within a block's flow.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea iframe title xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption caption summary".split())
#: Elements and roles that are no article text.
SKIPPED = set("head nav header footer aside form button select datalist input label dialog menu fieldset canvas audio video map search noscript template svg object-fallback".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Classes and ids (as whole words) that name adverts, reader comments, notices and page furniture.
NAMES = set(
    "ad ads advert adverts advertisement sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer cookie cookies notice notices popup modal newsletter "
    "share sharing social related comment comments disqus replies pagination pager toolbar banner".split()
)
#: Classes and ids of the main part.
MAIN_NAMES = set("article content main post entry story articlebody".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_CODE = re.compile(r"[a-zA-Z]{2,3}")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "tr": ("tr",), "option": ("option",)}


class _Node:
    __slots__ = ("tag", "skip", "article", "main", "parent", "parts", "hash", "text", "depth")

    def __init__(self, tag: str, parent: _Node | None, skip: bool, article: bool, main: bool):
        self.tag, self.parent, self.skip, self.article, self.main = tag, parent, skip, article, main
        self.parts: list[bytes] = []
        self.hash, self.text, self.depth = 0, False, parent.depth + 1 if parent else 0


def _attributes(raw: str) -> dict[str, str]:
    """Lower-cased names and values; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _kind(tag: str, raw: str, parent: _Node) -> tuple[bool, bool, bool]:
    """Whether the element is left out, begins an article, or begins the main part."""
    skip = tag in SKIPPED and not (tag == "header" and parent.article)
    article, main = tag == "article", tag == "main"
    if raw.strip(" /\t\r\n") and tag not in ("html", "body"):
        attrs = _attributes(raw)
        role, names = attrs.get("role", "").lower(), set((attrs.get("class", "") + " " + attrs.get("id", "")).lower().split())
        main |= role == "main" or "articlebody" in attrs.get("itemprop", "").lower() or (tag in ("div", "section") and bool(names & MAIN_NAMES))
        article |= role == "article"
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", "")
        skip |= role in ROLES or hidden or (bool(names & NAMES) and not (main or (article and not names & {"comment", "comments"})))
    return skip, article and not skip, main and not skip


def _declared(attributes: str) -> str | None:
    """The language code that the attributes of an html tag give."""
    said = _attributes(attributes)
    m = _CODE.match((said.get("lang") or said.get("xml:lang") or "").strip())
    return m[0].lower() if m else None


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open' or 'close', tag, attributes) in order, and ('cut', tag, attributes) where the page ends within a tag.

    Each step goes on from where the last one ended, and nothing is looked for twice.
    """
    at, end, lacking = 0, len(page), set()
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if lt > at:
                yield "text", page[at:lt], ""
            close = "-->" if page.startswith("<!--", lt) else ">"
            stop = page.find(close, lt + 4 if close == "-->" else lt + 2)
            at = end if stop < 0 else stop + len(close)
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            gt = page.find(">", lt) if closing and ">" not in lacking else -1
            if closing and gt < 0:
                lacking.add(">")
            stop = gt + 1 if gt >= 0 else lt + 1
            yield "text", page[at:lt] if gt >= 0 else page[at:stop], ""
            at = stop
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        tag, i = name.group().lower(), name.end()
        while True:
            m = _STOP.search(page, i)
            if m is None:
                yield "cut", tag, page[name.end() :]
                return
            if m.group() == ">":
                break
            i = m.end()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if m.group() not in lacking and page[before] == "=":
                stop = page.find(m.group(), i)
                if stop < 0:
                    lacking.add(m.group())
                else:
                    i = stop + 1
        at = m.end()
        yield "close" if closing else "open", tag, page[name.end() : m.start()]
        if tag in RAW and not closing:
            stop = _RAW_END[tag].search(page, at)
            at = end if stop is None else stop.start()


Block = tuple[str, list[int], list[int], bool, bool]


def read_page(page: str | None) -> tuple[list[Block], str | None]:
    """Blocks of the page in order: text, hashes of the containers around it, hashes of paragraphs of an article, in an article, in a main part;
    and the language that its first html tag with one declares, wherever the tag is."""
    if not page:
        return [], None
    declared = None
    root = _Node("", None, False, False, False)
    top, blocks, text, opened = root, [], [], Counter()

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                owner = top
                while owner.tag not in BLOCKS and owner is not root:
                    owner = owner.parent
                blocks.append((words, owner))
                owner.parts.append(words.encode("utf-8", "replace"))
                owner.text = True

    def close(node: _Node) -> None:
        nonlocal top
        if any_block(node):
            flush()
        while top is not node.parent:
            top.hash = xxhash.xxh64_intdigest(b"\x00".join([top.tag.encode(), *top.parts])) >> 1
            top.parent.text |= top.text
            top.parent.parts.append(top.hash.to_bytes(8, "big"))
            opened[top.tag] -= 1
            top = top.parent

    def any_block(node: _Node) -> bool:
        n = top
        while n is not node.parent:
            if n.tag in BLOCKS:
                return True
            n = n.parent
        return False

    def open_one(tag: str, stop: set[str]) -> _Node | None:
        if not opened[tag]:
            return None
        node = top
        while node is not root and node.tag not in stop:
            if node.tag == tag:
                return node
            node = node.parent
        return None

    for kind, tag, raw in _tokens(page):
        if kind == "text":
            if not top.skip:
                text.append(tag)
            continue
        if tag == "html" and declared is None and kind != "close":
            declared = _declared(raw)
        if kind == "cut":
            break
        if kind == "close":
            if tag == "br" and not top.skip:
                text.append(" ")
            found = open_one(tag, set() if tag in ("html", "body", "article", "main", "table") else {"td", "th", "table"} - {tag})
            if found is not None:
                close(found)
            continue
        if tag in RAW:
            continue  # its text is passed over
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not top.skip:
                text.append(" ")
            continue
        block = tag in BLOCKS
        if block and tag not in ("html", "body", "head") or tag == "body":
            flush()
            if (p := open_one("p", {"article", "section", "div", "td", "th", "li", "table", "blockquote", "main", "body", "button"})) is not None:
                close(p)
            if tag == "body" and (h := open_one("head", set())) is not None:
                close(h)
            for s in _SAME.get(tag, ()):
                if (o := open_one(s, {"ul", "ol", "dl", "table", "select"} | ({"tr"} if tag in ("td", "th") else set()))) is not None:
                    close(o)
        elif block:
            flush()
        if top.depth >= DEEPEST:
            continue
        skip, article, main = _kind(tag, raw, top)
        if (block or skip or top.skip) and not raw.endswith("/"):
            if skip and not top.skip and block:
                flush()
            top = _Node(tag, top, top.skip or skip, top.article or article, top.main or main)
            opened[tag] += 1
    flush()
    while top is not root:
        close(top)
    out = []
    for words, node in blocks:
        wide, narrow, n = [], [], node
        while n is not root:
            if n.tag not in ("html", "body", "article", "main"):
                (narrow if (n.article or n.main) and n.tag in LEAVES else wide).append(n.hash)
            n = n.parent
        out.append((words, wide, narrow, node.article, node.main))
    return out, declared


_BLOCK = "array<struct<t:string,h:array<bigint>,l:array<bigint>,a:boolean,m:boolean>>"


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks) of every page."""
    kind = dict(pages.dtypes)["page_id"]
    block = pa.list_(pa.struct([("t", pa.string()), ("h", pa.list_(pa.int64())), ("l", pa.list_(pa.int64())), ("a", pa.bool_()), ("m", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                read = [[dict(zip("thlam", (t.encode("utf-8", "replace").decode(), *x), strict=True)) for t, *x in read_page(p.as_py())[0]] for p in b.column(3)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(read, block)], ["page_id", "url", "host", "blocks"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, host string, blocks {_BLOCK}")


def _content(blocks: Column) -> Column:
    """The blocks in an article; without any, those in a main part; without any, all."""
    of = lambda flag: F.filter(blocks, lambda b: b[flag])
    return F.when(F.exists(blocks, lambda b: b["a"]), of("a")).when(F.exists(blocks, lambda b: b["m"]), of("m")).otherwise(blocks)


def templates(blocks: DataFrame, share: float = SHARE, leaf_share: float = LEAF_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hashes): subtrees that recur with many contents of the host; at most mean subtrees per page / share of them."""
    content = F.xxhash64(F.transform(_content(F.col("blocks")), lambda b: b["t"]))
    of = lambda part, least: F.transform(F.array_distinct(F.flatten(f"blocks.{part}")), lambda h: F.struct(h.alias("h"), F.lit(least).alias("least")))
    every = F.concat(of("h", share), of("l", leaf_share), F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0.0).alias("least"))))  # null stands for the page as such
    seen = blocks.select("host", content.alias("content"), F.explode(every).alias("x")).select("host", "content", "x.h", "x.least").distinct()
    counts = seen.groupBy("host", "h").agg(F.count("*").alias("n"), F.max("least").alias("least"))
    counts = scratch(counts.filter((F.col("n") >= min_pages) | F.col("h").isNull()), "templates")
    totals = counts.filter("h is null").select("host", F.col("n").alias("pages"))
    often = counts.filter("h is not null").join(totals, "host").filter(F.col("n") >= F.col("least") * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("h").alias("hashes"))


def main_text(pages: DataFrame, share: float = SHARE, leaf_share: float = LEAF_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Pages are parsed for the counts and again for the text: cheaper than keeping all blocks."""
    blocks = page_blocks(pages)
    rules = scratch(templates(blocks, share, leaf_share, min_pages), "rules")
    size = rules.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    joined = blocks.join(F.broadcast(rules) if size <= BROADCAST_HASHES else rules, "host", "left")
    stays = lambda b: ~F.arrays_overlap(b["h"], F.col("hashes")) & ~F.arrays_overlap(b["l"], F.col("hashes"))
    own = F.when(F.col("hashes").isNull(), F.col("blocks")).otherwise(F.filter("blocks", stays))
    text = F.array_join(F.transform("best", lambda b: b["t"]), "\n")
    best = joined.withColumn("own", own).withColumn("best", _content(F.col("own")))
    return best.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
