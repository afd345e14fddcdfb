"""URL and HTML functions as column expressions, and table extraction as a Pandas UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from graphloom.functions.text import squeeze


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][\w+.-]*://([^/?#:@]*)", 1))


def url_fragment(c: Column) -> Column:
    return F.regexp_extract(c, "#(.*)$", 1)


def url_selector(c: Column) -> Column:
    """Struct (section, subsection) of a fragment such as ``#section$sub``."""
    parts = F.split(url_fragment(c), r"\$", 2)
    return F.struct(F.get(parts, 0).alias("section"), F.get(parts, 1).alias("subsection"))


def urls_in(c: Column) -> Column:
    """URLs in a text, without closing punctuation, each once and in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"https?://[^\s<>\"']+"), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[).,;:!?\]]+$", "")))


def domain_matches(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def keep_url(c: Column, allow: list[str], deny: list[str], deny_prefixes: list[str] = ()) -> Column:
    """Allowed (all, if nothing is listed) and not denied by domain or prefix."""
    host = url_host(c)
    out = domain_matches(host, allow) if allow else F.lit(True)
    for p in deny_prefixes:
        out = out & ~c.startswith(p)
    return out & ~domain_matches(host, deny) & (host != "")


def html_title(c: Column) -> Column:
    """og:title, else the title element, else the first h1."""
    og = F.regexp_extract(c, r'(?is)<meta[^>]+property=["\']og:title["\'][^>]+content=["\']([^"\']*)', 1)
    title = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
    h1 = F.regexp_extract(c, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    clean = lambda x: squeeze(F.regexp_replace(x, "<[^>]+>", " "))
    return F.coalesce(*(F.nullif(clean(x), F.lit("")) for x in (og, title, h1)))


def html_text(c: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return squeeze(F.replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")))


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


def html_main(c: Column) -> Column:
    """The longest text among the article, main and body elements."""
    parts = [html_text(F.regexp_extract(c, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)) for t in ("article", "main", "body")]
    best = parts[0]
    for p in parts[1:]:
        best = F.when(F.char_length(best) > 0, best).otherwise(p)
    return best


def html_sections(c: Column) -> Column:
    """Array of struct (level, title, text): each heading with the text up to the next heading."""
    cut = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?i)(?=<h[1-6][\s>])"), lambda x: x.rlike("(?i)^<h[1-6]"))
    return F.transform(
        cut,
        lambda x: F.struct(
            F.regexp_extract(x, "(?i)^<h([1-6])", 1).cast("int").alias("level"),
            squeeze(F.regexp_replace(F.regexp_extract(x, r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1), "<[^>]+>", " ")).alias("title"),
            html_text(F.regexp_replace(x, r"(?is)^<h[1-6][^>]*>.*?</h[1-6]>", " ")).alias("text"),
        ),
    )


def section_text(c: Column, title: str, slug: bool = True) -> Column:
    """Text below the heading that matches a title, up to the next heading of its level or above."""
    key = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    want = "".join(ch for ch in title.lower() if ch.isalnum() and ch.isascii())
    s = html_sections(c)
    at = F.array_position(F.transform(s, lambda x: key(x["title"]) == want), True).cast("int")
    level = F.get(s, at - 1)["level"]
    rest = F.slice(s, at + 1, F.greatest(F.size(s) - at, F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda x: x["level"] <= level), True).cast("int")
    below = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    body = F.array_join(F.filter(F.concat(F.array(F.get(s, at - 1)["text"]), F.flatten(F.transform(below, lambda x: F.array(x["title"], x["text"])))), lambda x: x != ""), " ")
    return F.when(at > 0, body)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[dict] = []
        self.cell: list[str] | None = None
        self.kind = ""

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append({"caption": "", "headers": [], "rows": []})
        elif self.tables and tag == "tr":
            self.tables[-1]["rows"].append([])
        elif self.tables and tag in ("td", "th", "caption"):
            self.cell, self.kind = [], tag

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if self.cell is not None and tag == self.kind:
            text = " ".join("".join(self.cell).split())
            table = self.tables[-1]
            if tag == "caption":
                table["caption"] = text
            elif tag == "th" and len(table["rows"]) <= 1:
                table["headers"].append(text)
            elif table["rows"]:
                table["rows"][-1].append(text)
            self.cell = None


_TABLE = StructType([StructField("caption", StringType()), StructField("headers", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType())))])


@F.pandas_udf(ArrayType(_TABLE))
def html_tables(pages: pd.Series) -> pd.Series:
    """Tables of a page: caption, headers of the first row, and rows of cells."""

    def read(page: str | None) -> list[dict]:
        p = _Tables()
        p.feed(page or "")
        return [t | {"rows": [r for r in t["rows"] if r]} for t in p.tables]

    return pages.map(read)


def extractive_summary(sentences: Column, target: int, cap: int) -> Column:
    """Leading sentences until ``target`` words are reached, never beyond ``cap``."""
    size = lambda x: F.size(F.split(F.trim(x), r"\s+"))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["stop"] | (acc["n"] >= target) | (acc["n"] + size(x) > cap)
        return F.struct(
            F.when(stop, acc["n"]).otherwise(acc["n"] + size(x)).alias("n"), stop.alias("stop"),
            F.when(stop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
        )

    return F.array_join(F.aggregate(sentences, start, step, lambda a: a["kept"]), " ")
