"""Structured data in pages: JSON-LD and page-state scripts to article candidates.

Script blocks are cut out on the JVM; only pages that have one reach Python, which walks their JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a walk (fixed values): characters of a script, scripts and candidates of a page, depth, objects, entries
#: of one array.
CHARS, SCRIPTS, CANDIDATES, DEPTH, OBJECTS, ENTRIES = 1_000_000, 20, 20, 12, 2_000, 200
#: Types of article nodes, and those of list entries and lists that hold none (fixed values).
ARTICLES = {"Article", "NewsArticle", "ReportageNewsArticle", "AnalysisNewsArticle", "BlogPosting", "LiveBlogPosting", "OpinionNewsArticle", "ReviewNewsArticle", "BackgroundNewsArticle"}
NO_ENTRY = {"Product", "Person", "Organization", "Place", "Event", "Recipe", "BreadcrumbList", "SiteNavigationElement", "WebPage", "CollectionPage", "SearchResultsPage", "ProfilePage", "AboutPage", "ContactPage"}
NO_LIST = {"BreadcrumbList", "SiteNavigationElement"}
_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_NEXT = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""


def script_blocks(html: Column) -> Column:
    """The JSON-LD scripts of a page, trimmed, blank ones left out."""
    return F.slice(F.filter(F.transform(F.regexp_extract_all(html, F.lit(_LD), 1), lambda x: F.left(F.trim(x), F.lit(CHARS))), lambda x: x != ""), 1, SCRIPTS)


def next_data(html: Column) -> Column:
    """The page-state script of a page, or null."""
    return F.nullif(F.left(F.trim(F.regexp_extract(html, _NEXT, 1)), F.lit(CHARS)), F.lit(""))


def parse(text: str | None):
    try:
        return json.loads(text) if text and len(text) <= CHARS else None
    except (ValueError, RecursionError):
        return None


def types(raw) -> list[str]:
    """Declared types without their prefix."""
    return [t.split(":", 1)[-1] for t in (raw if isinstance(raw, list) else [raw]) if isinstance(t, str)]


def objects(root, wanted: Callable[[dict], bool]) -> list[dict]:
    """Objects of a JSON value, in order, that ``wanted`` takes; within the bounds above."""
    out: list[dict] = []
    stack, seen = [(root, 0)], 0
    while stack and seen < OBJECTS:
        node, depth = stack.pop()
        if depth > DEPTH:
            continue
        if isinstance(node, list):
            inner = node[:ENTRIES]
        elif isinstance(node, dict):
            seen += 1
            if wanted(node):
                out.append(node)
            inner = list(node.values())
        else:
            continue
        stack.extend((x, depth + 1) for x in reversed(inner))
    return out


def _text(o, *names: str) -> str | None:
    return next((o[n] for n in names if isinstance(o, dict) and isinstance(o.get(n), str) and o[n].strip()), None)


def _resolve(url: str | None, base: str) -> str | None:
    try:
        full = urljoin(base or "", url or "")
        return full if url and urlsplit(full).scheme in ("http", "https") and urlsplit(full).netloc else None
    except ValueError:
        return None


def _author(o: dict) -> str | None:
    a = o.get("author")
    a = a[0] if isinstance(a, list) and a else a
    return a if isinstance(a, str) else _text(a, "name")


def candidates(blocks: list[str], state: str | None, base: str) -> list[tuple]:
    """(url, headline, date, author, type) of a page's articles: article nodes and list entries of its JSON-LD, then
    its page state; an address once."""
    out: dict[str, tuple] = {}

    def add(url, headline, date, author, kind):
        if url and url not in out and len(out) < CANDIDATES:
            out[url] = (url, headline, date, author, kind)

    for text in blocks:
        root = parse(text)
        for o in objects(root, lambda o: any(t in ARTICLES for t in types(o.get("@type")))):
            page = o.get("mainEntityOfPage")
            link = _text(o, "url") or _text(page, "@id", "url") or (page if isinstance(page, str) else None) or _text(o, "@id")
            add(_resolve(link, base), _text(o, "headline"), _text(o, "datePublished"), _author(o), types(o.get("@type"))[0])
        for o in objects(root, lambda o: "ItemList" in types(o.get("@type")) and not NO_LIST & set(types(o.get("@type")))):
            entries = o.get("itemListElement")
            for e in entries[:ENTRIES] if isinstance(entries, list) else []:
                item = e.get("item") if isinstance(e, dict) else None
                if isinstance(e, dict) and not NO_ENTRY & set(types(item.get("@type")) if isinstance(item, dict) else []):
                    add(_resolve(_text(item, "url", "@id") or _text(e, "url"), base), _text(item, "name", "headline") or _text(e, "name"), None, None, "ItemList")
    props = parse(state)
    props = props.get("props", {}) if isinstance(props, dict) else {}
    lists: list = []
    for o in objects(props.get("pageProps") if isinstance(props, dict) else None, lambda o: True):
        lists += [v for v in o.values() if isinstance(v, list)]
    for entries in lists:
        for e in entries[:ENTRIES]:
            title, date = _text(e, "title", "headline", "name"), _text(e, "publishedAt", "date", "datePublished", "createdAt")
            if title or date:
                add(_resolve(_text(e, "url", "slug", "href", "link"), base), title, date, None, "NextData")
    return list(out.values())


def page_articles(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, ord, url, headline, published_at, author, type): article candidates of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *c) for k, x, s, u in zip(b[key], b["blocks"], b["state"], b["base"]) for i, c in enumerate(candidates(list(x), s, u))]
            yield pd.DataFrame(rows, columns=[key, "ord", "url", "headline", "published_at", "author", "type"])

    kind = df.schema[key].dataType.simpleString()
    some = df.select(key, script_blocks(F.col(html)).alias("blocks"), next_data(F.col(html)).alias("state"), F.col(url).alias("base")).where("size(blocks) > 0 or state is not null")
    return some.mapInPandas(run, f"`{key}` {kind}, ord int, url string, headline string, published_at string, author string, type string")


#: Article types whose nodes can declare a wall, the part that does, and most signals of a page (fixed values).
WALLED, WALLED_PART, SIGNALS = {"article", "newsarticle", "reportagenewsarticle", "analysisnewsarticle"}, "paywalledcontent", 8


def _where(address: str | None, base: str | None) -> str | None:
    """Origin and path of an address, None where it is none; letter case of the path counts."""
    try:
        u = urlsplit(urljoin(base or "", (address or "").strip()))
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
        return f"{u.scheme}://{u.hostname}{port}{u.path.rstrip('/') or '/'}" if u.scheme in ("http", "https") and u.hostname else None
    except ValueError:
        return None


def _own_address(node: dict) -> str | None:
    page = node.get("mainEntityOfPage")
    inner = [page.get("url"), page.get("@id")] if isinstance(page, dict) else [page]
    return next((x.strip() for x in [node.get("url"), node.get("@id"), *inner] if isinstance(x, str) and x.strip()), None)


def wall_signals(values: list, address: str | None) -> list[tuple[str, str]]:
    """(code, state) of the walls that a page's structured data declare for its article: ``matched`` where the node has
    the page's address (or stands in one that has), ``unstated`` where it has none, which counts only if it is the
    page's one article and nothing matched.  Nodes of other addresses declare nothing, nor does any where the page's own
    address is malformed."""
    here = _where(address, None)
    if here is None and (address or "").strip():
        return []
    found: list[tuple[str, str]] = []
    articles = others = 0
    stack = [(v, None, False) for v in reversed(values)]
    while stack:
        node, above, inside = stack.pop()
        if isinstance(node, list):
            stack += [(x, above, inside) for x in reversed(node)]
            continue
        if not isinstance(node, dict):
            continue
        own = _own_address(node) or above
        state = ("matched" if _where(own, address) == here else "conflicting") if own and here else "matched" if inside else "unstated"
        if WALLED & {t.strip().lower() for t in types(node.get("@type"))}:
            articles += 1
            others += state == "conflicting"
            if node.get("isAccessibleForFree") is False:
                found.append(("isAccessibleForFree:false", state))
            parts = node.get("hasPart")
            for part in parts if isinstance(parts, list) else [parts]:
                if isinstance(part, dict) and WALLED_PART in {t.lower() for t in types(part.get("@type"))}:
                    found.append(("PaywalledContent", state))
        stack += [(x, own, state == "matched") for x in reversed(list(node.values())) if isinstance(x, (dict, list))]
    sure = [f for f in found if f[1] == "matched"]
    alone = articles == 1 and not others
    return (sure or [f for f in found if f[1] == "unstated" and alone])[:SIGNALS]


def page_walls(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, ord, code, state) of wall_signals() for each page; broken scripts and pages without any give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *s) for k, x, u in zip(b[key], b["blocks"], b["base"]) for i, s in enumerate(wall_signals([parse(t) for t in x], u))]
            yield pd.DataFrame(rows, columns=[key, "ord", "code", "state"])

    kind = df.schema[key].dataType.simpleString()
    some = df.select(key, script_blocks(F.col(html)).alias("blocks"), F.col(url).alias("base")).where("size(blocks) > 0")
    return some.mapInPandas(run, f"`{key}` {kind}, ord int, code string, state string")
