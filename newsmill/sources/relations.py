"""What pages and their headers point to: feeds, the next pages of a listing, an AMP rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .pages import read_page

#: Types of feeds (fixed values).
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json", "application/json"]
#: Addresses and labels of a listing's next pages (fixed values).
PAGE_ADDRESS = re.compile(r"[?&](?:page|p)=|/page/\d", re.I)
PAGE_LABEL = re.compile(r"next|older|more|page\s*\d", re.I)
FEED_PATH, NO_FEED_PATH, FEED_QUERY = (re.compile(p, re.I) for p in (U.FEED_PATH, U.NO_FEED_PATH, U.FEED_QUERY))


def resolve(address: str | None, base: str | None) -> str | None:
    """An address as seen from a page, null where it leads to no page."""
    try:
        out = urljoin(base or "", (address or "").strip())
        return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
    except ValueError:
        return None


def _host(url: str) -> str:
    return re.sub(r"^www\.", "", (urlsplit(url).hostname or "").lower())


def _is_feed(url: str) -> bool:
    u = urlsplit(url)
    return not NO_FEED_PATH.search(u.path) and bool(FEED_PATH.search(u.path) or FEED_QUERY.search(u.query))


def relations(html: str | None, base: str | None) -> list[tuple[str, str]]:
    """(kind, url) of a page in order, each once: declared feeds, anchors that name feeds, AMP of the same site, next
    pages of the same site.  Null and empty pages, and pages without an address, have none."""
    if not html or resolve("", base) is None:
        return []
    page = read_page(html)
    found = [("declared_feed", h) for rel, kind, h in page.relations if "alternate" in rel and any(t in kind for t in FEED_TYPES)]
    found += [("amp", h) for rel, _, h in page.relations if "amphtml" in rel.split()]
    for (href, text), (rel, note) in zip(page.links, page.notes):
        if href.startswith(("#", "javascript:")):
            continue
        if _is_feed(resolve(href, base) or ""):
            found.append(("anchor_feed", href))
        elif PAGE_ADDRESS.search(href) or "next" in rel.split() or PAGE_LABEL.search(f"{text} {note}"):
            found.append(("next_page", href))
    out: dict[tuple[str, str], None] = {}
    for kind, href in found:
        url = resolve(href, base)
        if url and (kind in ("declared_feed", "anchor_feed") or _host(url) == _host(base)):
            out[kind, url] = None
    return list(out)


def page_relations(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, ord, kind, url) of ``relations``; ``ord`` counts within a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, kind, url) for k, h, a in zip(b[key], b[html], b[base]) for i, (kind, url) in enumerate(relations(h, a))]
            yield pd.DataFrame(rows, columns=[key, "ord", "kind", "url"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html, base).mapInPandas(run, f"`{key}` {kind}, ord int, kind string, url string")


def resolved(address: Column, base: Column) -> Column:
    """``resolve`` as a column, in Arrow batches."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, "string")(address, base)


def header_feeds(header: Column) -> Column:
    """Array of (target, type) of a Link header's alternates that are feeds; targets as written."""
    one = lambda e, p: F.regexp_extract(e, p, 1)
    entries = F.transform(
        F.split(F.coalesce(header, F.lit("")), r",(?=\s*<)"),
        lambda e: F.struct(one(e, "<([^>]+)>").alias("target"), F.lower(one(e, r'(?i);\s*rel="?([^";,]+)')).alias("rel"), F.lower(one(e, r'(?i);\s*type="?([^";,]+)')).alias("type")),
    )
    kept = F.filter(entries, lambda e: (e["target"] != "") & e["rel"].contains("alternate") & e["type"].rlike("|".join(re.escape(t) for t in FEED_TYPES)))
    return F.transform(kept, lambda e: F.struct(e["target"].alias("target"), F.trim(e["type"]).alias("type")))
