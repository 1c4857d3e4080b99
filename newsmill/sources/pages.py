"""Fetched pages to rows: metadata, paragraphs and links, by one tolerant pass over the markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_date

#: Elements without content of the page's own (fixed values).
SKIPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg", "button", "template"}
#: Elements that end a paragraph (fixed values).
BREAKS = {"p", "div", "article", "section", "li", "ul", "ol", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "main", "figure"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


_META = r"""(?i)<meta[^>]+(?:%s)=["'](?:%s)["'][^>]+content=["']([^"']+)["']"""
#: Where a page's date is written, best first (fixed values): source, pattern, how it is written.
DATE_PLACES = [
    ("article:published_time", _META % ("property|name", "article:published_time"), '<meta property="article:published_time" content="%s">'),
    ("og:published_time", _META % ("property|name", "og:published_time"), '<meta property="og:published_time" content="%s">'),
    ("pubdate", _META % ("name", "pubdate|publishdate"), '<meta name="pubdate" content="%s">'),
    ("datePublished", r'(?i)"datePublished"\s*:\s*"([^"]+)"', '<script type="application/ld+json">{"datePublished": "%s"}</script>'),
    ("meta[itemprop=datePublished]", _META % ("itemprop", "datePublished"), '<meta itemprop="datePublished" content="%s">'),
    ("time[datetime]", r"""(?i)<time[^>]+datetime=["']([^"']+)["']""", '<time datetime="%s">x</time>'),
    ("meta[name=date]", _META % ("name", "date"), '<meta name="date" content="%s">'),
    ("article:modified_time", _META % ("property|name", "article:modified_time"), '<meta property="article:modified_time" content="%s">'),
    ("og:updated_time", _META % ("property|name", "og:updated_time"), '<meta property="og:updated_time" content="%s">'),
]
#: How many of DATE_PLACES come before a date in the address.
BEFORE_ADDRESS = 7


def _found(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_date(html: Column, url: Column) -> Column:
    """struct(raw, source): a page's date as written and where, publication before modification; nulls for none."""
    places = [F.struct(_found(html, p).alias("raw"), F.lit(s).alias("source")) for s, p, _ in DATE_PLACES]
    address = F.struct(url_date(url).cast("string").alias("raw"), F.lit("url_date").alias("source"))
    return F.get(F.filter(F.array(*places[:BEFORE_ADDRESS], address, *places[BEFORE_ADDRESS:]), lambda x: x["raw"].isNotNull()), F.lit(0))


def meta_by_pattern(html: Column) -> Column:
    """struct(title, description, published_at, keywords) of a page by patterns, for listings whose pages aren't parsed."""
    some = lambda *ps: F.coalesce(*[_found(html, p) for p in ps])
    words = F.filter(F.transform(F.split(some(_META % ("name", "keywords")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        F.trim(some(_META % ("property", "og:title"), _META % ("name", "twitter:title"), r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        F.trim(some(_META % ("name", "description"), _META % ("property", "og:description"), _META % ("name", "twitter:description"))).alias("description"),
        some(*[DATE_PLACES[i][1] for i in (0, 1, 2, 5)]).alias("published_at"),
        words.alias("keywords"),
    )


class _Page(HTMLParser):
    """Collects what the functions below return; unclosed elements and stray ends don't matter."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.paragraphs: list[tuple[str, bool, int]] = []
        self.links: list[tuple[str, str]] = []
        self.notes: list[tuple[str, str]] = []
        self.relations: list[tuple[str, str, str]] = []
        self._skip: list[str] = []
        self._text: list[str] = []
        self._linked = 0
        self._article = 0
        self._title = self._h1 = False
        self._href: str | None = None
        self._anchor: list[str] = []
        self._note = ("", "")

    def _flush(self):
        t = " ".join("".join(self._text).split())
        if t:
            self.paragraphs.append((t, self._article > 0, min(self._linked, len(t))))
        self._text, self._linked = [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        elif tag == "link" and a.get("href"):
            rel = (a.get("rel") or "").lower()
            self.relations.append((rel, (a.get("type") or "").lower(), a["href"]))
            if "canonical" in rel:
                self.meta.setdefault("canonical", a["href"])
        elif tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        elif tag == "title":
            self._title = True
        elif tag == "a" and a.get("href"):
            self._href, self._anchor = a["href"], []
            self._note = ((a.get("rel") or "").lower(), f"{a.get('aria-label') or ''} {a.get('title') or ''}")
        if tag in SKIPPED:
            self._flush()
            self._skip.append(tag)
        elif tag in BREAKS:
            self._flush()
            self._h1 = tag == "h1" or (self._h1 and tag == "br")
            self._article += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in self._skip:
            while self._skip and self._skip.pop() != tag:
                pass
        elif tag == "title":
            self._title = False
        elif tag == "a" and self._href is not None:
            self.links.append((self._href, " ".join("".join(self._anchor).split())))
            self.notes.append(self._note)
            self._href = None
        elif tag in BREAKS:
            self._flush()
            self._h1 = False
            self._article -= tag in ("article", "main") and self._article > 0

    def handle_data(self, data):
        if self._href is not None:
            self._anchor.append(data)
        if self._title:
            self.meta["title"] = self.meta.get("title", "") + data
        elif not self._skip:
            if self._h1:
                self.meta["h1"] = self.meta.get("h1", "") + data
            self._text.append(data)
            self._linked += len(data) if self._href is not None else 0


def read_page(html: str | None) -> _Page:
    p = _Page()
    if html:
        p.feed(html)
        p.close()
        p._flush()
    return p


def _first(m: dict[str, str], *names: str) -> str | None:
    return next((" ".join(m[n].split()) for n in names if m.get(n, "").strip()), None)


def page_meta(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, canonical_url, title, excerpt, image_url, author, published_at), each from the first place that has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h in zip(b[key], b[html]):
                m = read_page(h).meta
                rows.append((
                    k, _first(m, "canonical", "og:url"), _first(m, "og:title", "twitter:title", "h1", "title"), _first(m, "og:description", "description", "twitter:description"), _first(m, "og:image", "twitter:image"),
                    _first(m, "author", "article:author"), _first(m, "article:published_time", "date", "time"),
                ))
            yield pd.DataFrame(rows, columns=[key, "canonical_url", "title", "excerpt", "image_url", "author", "published_at"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, canonical_url string, title string, excerpt string, image_url string, author string, published_at string")


def page_paragraphs(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, paragraph, in_article, link_share): text blocks in order, without navigation and the like."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, t, art, round(n / len(t), 6)) for k, h in zip(b[key], b[html]) for i, (t, art, n) in enumerate(read_page(h).paragraphs)]
            yield pd.DataFrame(rows, columns=[key, "ord", "paragraph", "in_article", "link_share"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, ord int, paragraph string, in_article boolean, link_share double")


def page_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, href, text) of the anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, h, t) for k, x in zip(b[key], b[html]) for i, (h, t) in enumerate(read_page(x).links)]
            yield pd.DataFrame(rows, columns=[key, "ord", "href", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, ord int, href string, text string")
