"""Main-text extraction: block structure, and the suffix array of a host for pages without it.

A page is read into blocks. What its structure names as no part of the text
(elements and landmark roles of menus, headers, footers, sidebars, forms, scripts
and styles) is left out; where the page has an article element, the blocks inside
are its text, and an empty article is an empty text. An article element in a
comment, a script or a part left out is none.

Adverts, notices, sharing bars and reader comments have no element of their own;
they are told by the names of their containers. A name counts only if every one of its
words does (``comment-list``, but not ``entry-header`` or ``search-results``), on
containers only, never on headings or paragraphs; inside an article the names of
headers and searches say nothing.

Pages without an article are compared with all other pages of their host. The
token streams of the host's distinct pages are concatenated and their suffix
array built; every run of ``LONG`` tokens or more that occurs in two distinct pages is
boilerplate, and what is left of each block is the text. Copies of a page count
once, so they keep their text. One host's array is one task, so hosts of more than
``HOST_CHARS`` characters are done another way with the same result: every window of
``LONG`` tokens is dealt by a 128-bit hash of host and tokens, and those met in two
pages are boilerplate; the pages of such a host are never brought together.

Repeats do not decide inside an article: passages that several articles share
belong to each of them.

Defined results: null or empty html has the empty text; an unclosed element ends
with its parent, an unclosed comment with the page; white space is any Unicode
white space; a null url is a host of its own; repeated rows each get a row and
count as one page; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, tidy
from graphloom.llm.suffix_array import suffix_array
from graphloom.llm.urls import host_of

#: Tokens in a repeat that counts as boilerplate.
LONG = 8
#: Characters of distinct pages up to which a host is one suffix array.
HOST_CHARS = 1 << 20
#: Parts that the copies of one page are dealt into.
COPIES = 64

# Element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object"}
LEFT_OUT = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "audio", "video", "canvas", "map", "label", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that a stray end tag of another kind does not close.
HOLDERS = {"article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "table", "td", "th", "body", "html", "blockquote", "ul", "ol", "dialog"}
#: Elements whose class or id may name them as no part of the text.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details", "figure", "center", "address"}
# Landmark roles of what is no part of the text.
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "menu", "menubar", "dialog", "alertdialog"}
# Words in names of what is no part of the text, also in an article; words of headers and searches; words that may stand beside them.
PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup",
    "newsletter", "subscribe", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "disqus", "replies", "pagination", "pager", "login",
}
TOPS = {"header", "masthead", "banner", "search", "toolbar"}
BESIDE = {
    "area", "bar", "block", "box", "btn", "button", "buttons", "container", "content", "form", "group", "inner", "item", "items", "left", "links", "list", "main", "modal", "overlay", "page", "post",
    "posts", "right", "section", "site", "slot", "thread", "top", "bottom", "unit", "user", "widget", "wrap", "wrapper",
}

_TAG = re.compile(r"<!--(.*?)(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"(?:\s|^|[\"'/])(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _names_a_part(value: str, parts: set[str]) -> bool:
    """Whether one of the names says nothing but parts of a page that are no text."""
    for name in value.split():
        found = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
        if any(w in parts for w in found) and all(w in parts or w in BESIDE for w in found):
            return True
    return False


def _attributes(element: str, text: str, inside: bool) -> tuple[bool, bool]:
    """(no part of the text, an article) by the attributes of an element, inside an article or not."""
    out = main = False
    for name, a, b, c in _NAMES.findall(text):
        value, name = a or b or c, name.lower()
        if name == "itemprop":
            main |= value == "articleBody"
        elif name == "role":
            main |= value == "main"
            out |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            out = True
        elif element in CONTAINERS:
            out |= _names_a_part(value, PARTS if inside else PARTS | TOPS)
    return out, main


def blocks(html: str) -> tuple[list[str] | None, list[str]]:
    """Blocks inside articles (None where the page has no article), and all blocks that are not left out."""
    inside: list[str] = []
    has_article = False
    everything: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, left out, article; both of this element or one around it
    at, n = 0, len(html)

    def end_block(main: bool) -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                everything.append(text)
                if main:
                    inside.append(text)

    while at < n:
        m = _TAG.search(html, at)
        out, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        text = html[at : m.start()] if m else html[at:]
        if text and not out:
            parts.append(text)
        if not m:
            break
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            if m[2] and not out:
                parts.append(m[2].replace("&", "&amp;"))
            continue
        if name in BLOCKS:
            end_block(main)
        elif name == "br":
            parts.append(" ")
        if m[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDERS and name not in HOLDERS:
                    break
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]|\Z", re.IGNORECASE).search(html, at)
            at = html.find(">", close.start()) + 1 or n if close.start() < n else n
        elif name not in VOID and not m[5].endswith("/"):
            marked, article = _attributes(name, m[5], main) if m[5] else (False, False)
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            structural = name in LEFT_OUT and not (name == "header" and main)
            article |= name in ("article", "main")
            if name in ("body", "html", "article", "main"):
                marked = False
            has_article |= article and not (out or structural or marked)
            stack.append((name, out or structural or marked, main or article))
    end_block(stack[-1][2] if stack else False)
    return inside if has_article else None, everything


def unique_runs(pages: list[list[str]], long: int = LONG) -> list[list[str]]:
    """The pages' blocks without the tokens of any ``long`` repeat in two distinct pages."""
    number: dict[str, int] = {}
    stream: list[int] = []
    page_of: list[int] = []
    for p, page in enumerate(pages):
        for block in page:
            for w in block.split():
                stream.append(number.setdefault(w, len(number) + 1))
                page_of.append(p)
        stream.append(0)
        page_of.append(-1)
    gone = bytearray(len(stream))
    order = suffix_array(stream)

    def begins(i: int) -> list[int] | None:
        head = stream[i : i + long]
        return head if len(head) == long and 0 not in head else None

    run: list[int] = []
    last = None
    for i in [*order, None]:
        head = begins(i) if i is not None else None
        if head != last or head is None:
            if len({page_of[k] for k in run}) > 1:
                for k in run:
                    gone[k : k + long] = b"\1" * long
            run, last = [], head
        if head is not None:
            run.append(i)
    out, at = [], 0
    for page in pages:
        kept = []
        for block in page:
            words = block.split()
            left = " ".join(w for k, w in enumerate(words) if not gone[at + k])
            at += len(words)
            if left:
                kept.append(left)
        at += 1
        out.append(kept)
    return out


def window_keys(host: str, words: list[str], long: int = LONG) -> list[bytes]:
    """A hash of host and tokens for every window of ``long`` tokens."""
    return [blake2b("\n".join([host, *words[k : k + long]]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in range(len(words) - long + 1)]


def without(body: str, hits, long: int = LONG) -> str:
    """The blocks of ``body`` without the windows that begin at the tokens ``hits``; blocks left empty go."""
    gone = {k for h in hits for k in range(h, h + long)}
    out, at = [], 0
    for block in body.split("\n") if body else []:
        words = block.split()
        kept = [w for k, w in enumerate(words, at) if k not in gone]
        at += len(words)
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    schema = rows.select("page_id", "url", F.col("html").alias("text"), F.lit(True).alias("article")).schema

    def parse(batches):
        for b in batches:
            texts, article = [], []
            for page in b.column("html").to_pylist():
                inside, everything = blocks(page)
                texts.append("\n".join(everything if inside is None else inside))
                article.append(inside is not None)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(article, pa.bool_())], schema.names)

    parsed = cut(rows.mapInArrow(tidy(parse), schema), "blocks")
    n_chars = F.char_length("text").cast("long").alias("n_chars")
    known = parsed.filter("article").select("page_id", "url", "text", n_chars)
    plain = parsed.filter("not article")
    if plain.isEmpty():
        return known
    bodies = plain.select("page_id", "url", F.col("text").alias("body"), host_of(F.col("url")).alias("host"))
    bodies = bodies.withColumns({"page": F.xxhash64("body"), "part": F.pmod(F.xxhash64("page_id", "url"), F.lit(COPIES))})
    return known.unionByName(unique_texts(bodies).select("page_id", "url", "text", n_chars))


def unique_texts(bodies: DataFrame) -> DataFrame:
    """``bodies(page_id, url, body, host, page, part)`` with ``text``: what does not repeat on other pages of the host."""
    distinct = bodies.select("host", "page", F.char_length("body").alias("n")).distinct()
    sizes = cut(distinct.groupBy("host").agg(F.sum("n").alias("chars")), "hosts")
    keys = ["host", "page"]

    def by_array(batches):
        host, held = None, []

        def finish() -> pa.RecordBatch:
            kept = unique_runs([x.split("\n") if x else [] for _, x in held])
            return pa.RecordBatch.from_arrays([pa.array([host] * len(held), pa.string()), pa.array([p for p, _ in held], pa.int64()), pa.array(["\n".join(k) for k in kept], pa.string())], [*keys, "text"])

        for b in batches:
            for h, page, body in zip(*(b.column(c).to_pylist() for c in (*keys, "body"))):
                if h != host and held:
                    yield finish()
                    held = []
                host = h
                held.append((page, body))
        if held:
            yield finish()

    small = bodies.join(sizes.filter(F.col("chars") <= HOST_CHARS), "host").groupBy(*keys).agg(F.first("body").alias("body"))
    whole = small.repartition("host").sortWithinPartitions(*keys).mapInArrow(tidy(by_array), "host string, page long, text string")

    large = bodies.join(sizes.filter(F.col("chars") > HOST_CHARS), "host")

    def windows(batches):
        for b in batches:
            for host, page, part, body in zip(*(b.column(c).to_pylist() for c in ("host", "page", "part", "body"))):
                found = window_keys(host, body.split())
                n = len(found)
                columns = [pa.array([host] * n, pa.string()), pa.array([page] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["host", "page", "part", "at", "key"])

    def erase(batches):
        for b in batches:
            texts = [without(body, hits or ()) for body, hits in zip(b.column("body").to_pylist(), b.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    seen = large.select("host", "page", "part", "body").mapInArrow(tidy(windows), "host string, page long, part long, at int, key binary")
    shared = seen.groupBy("key").agg(F.min("page").alias("low"), F.max("page").alias("high")).filter("low < high").select("key")
    hits = seen.join(shared, "key").groupBy("host", "page", "part").agg(F.collect_set("at").alias("hits"))
    left = large.join(hits, ["host", "page", "part"], "left").select("page_id", "url", "body", "hits")
    erased = left.mapInArrow(tidy(erase), left.select("page_id", "url", F.col("body").alias("text")).schema)
    return bodies.drop("body", "part").join(whole, keys).select("page_id", "url", "text").unionByName(erased)
