"""Queries on found links and on what pages point to, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import discovery as D
from ..session import table
from ..sources import relations
from .url_plans import PATH, parts_sql

QUERIES, ORACLE = {}, {}
c = F.col
SECTION = "/sport"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def site_links(spark, sf):
    """Links of feed items beside their source's site."""
    sites = U.with_url(table(spark, sf, "sources").select("source_id", "front_page_url"), "front_page_url", "s_").select("source_id", U.domain_key("s_").alias("site"))
    items = table(spark, sf, "feed_items").select("item_id", "source_id", "link", "title", "pub_date")
    return D.with_link(items.join(sites, "source_id"), "link")


_SITE = r"CASE WHEN {p}_scheme IN ('http', 'https') THEN regexp_replace({p}_host, '^www\.|\.$', '', 'g') END"
_SITES = f"SELECT source_id, {_SITE.format(p='u')} AS site FROM {parts_sql('SELECT source_id, front_page_url FROM sources', 'front_page_url')}"
_LINKS = f"(SELECT i.*, site, {_SITE.format(p='u')} AS domain, {PATH} AS path FROM {parts_sql('SELECT item_id, source_id, link, title, pub_date FROM feed_items', 'link')} i JOIN ({_SITES}) USING (source_id))"
_UTILITY = "CASE " + " ".join(f"WHEN regexp_matches(lower({{p}}), '{p}') THEN '{r}'" for p, r in D.UTILITY) + " END"
_BARE = "regexp_replace(u_path, '^/+|/+$', '', 'g')"


@query(
    f"""SELECT item_id, {_UTILITY.format(p='path')} AS utility,
    coalesce(domain = site AND {_BARE} <> '' AND (contains({_BARE}, '/') OR length({_BARE}) >= 18 OR regexp_matches({_BARE}, '-.*-') OR regexp_matches({_BARE}, '[0-9]{{4}}')), false) AS article_like,
    coalesce(u_scheme IN ('http', 'https') AND (regexp_matches(lower(u_path), '{D.REDIRECT_PATH}') OR regexp_matches(lower(u_query), '{D.REDIRECT_QUERY}')), false) AS redirector FROM {_LINKS}"""
)
def link_filter(spark, sf):
    t = site_links(spark, sf)
    return t.select("item_id", c("u_utility").alias("utility"), D.is_article_like(c("site")).alias("article_like"), D.is_redirector().alias("redirector"))


_TESTS = {
    "same_domain": "domain = site",
    "not_utility": _UTILITY.format(p="path") + " IS NULL",
    "multi_segment_path": "regexp_matches(path, '[^/]/+[^/]')",
    "date_in_url": f"regexp_matches(path, '{D.DATED_PATH}')",
    "slug_pattern": "length(split_part(path, '/', -1)) >= 12 AND regexp_matches(split_part(path, '/', -1), '-.*-')",
    "category_match": f"path = '{SECTION}' OR starts_with(path, '{SECTION}/')",
    "has_title": f"length(title) >= {D.TITLE_LENGTH}",
    "has_date": "pub_date <> ''",
}


@query(
    f"""WITH t AS (SELECT item_id, u_host, domain, site, {", ".join(f"coalesce(({s}), false) AS {n}" for n, s in _TESTS.items())}, {_UTILITY.format(p='path')} AS utility FROM {_LINKS}),
    s AS (SELECT *, CAST(CASE WHEN same_domain AND not_utility THEN {" + ".join(f"CASE WHEN {n} THEN {p} ELSE 0 END" for n, p in D.POINTS.items())} ELSE 0 END AS INT) AS score FROM t)
    SELECT item_id, score, CASE WHEN u_host IS NULL OR site IS NULL THEN 'invalid_url' WHEN coalesce(domain <> site, true) THEN 'different_domain' WHEN utility IS NOT NULL THEN utility WHEN score < {D.ENOUGH} THEN 'low_score' END AS rejection FROM s"""
)
def url_score(spark, sf):
    t = site_links(spark, sf)
    t = U.once(t, signals=D.link_signals(c("site"), F.lit(SECTION), c("title"), c("pub_date")))
    t = U.once(t, score=D.link_score(c("signals")))
    return t.select("item_id", c("score").cast("int").alias("score"), D.rejection(c("site"), c("score")).alias("rejection"))


@query(
    """SELECT reason, count(*) AS n, min(item_id) AS first_item FROM (SELECT item_id, coalesce(rejection, 'accepted') AS reason FROM (""" + ORACLE["url_score"] + """)) GROUP BY reason"""
)
def url_score_reasons(spark, sf):
    return url_score(spark, sf).groupBy(F.coalesce("rejection", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


_ROOT = "regexp_extract(front_page_url, '^[A-Za-z]+://[^/?#]+')"


@query(
    f"""SELECT source_id, unnest(['/a/b', 'https://other.example/x', '//cdn.example/y', '?page=2', 'mailto:x@y.example', '']) AS address, unnest([{_ROOT} || '/a/b', 'https://other.example/x', regexp_extract(front_page_url, '^[A-Za-z]+:') || '//cdn.example/y', {_ROOT} || '/s/?page=2', NULL, {_ROOT} || '/s/']) AS resolved FROM sources"""
)
def resolve_url(spark, sf):
    """Addresses of every kind, seen from a section of each source."""
    base = F.concat(F.regexp_extract("front_page_url", "^[A-Za-z]+://[^/?#]+", 0), F.lit("/s/"))
    kinds = F.explode(F.array(*map(F.lit, ["/a/b", "https://other.example/x", "//cdn.example/y", "?page=2", "mailto:x@y.example", ""])))
    t = table(spark, sf, "sources").select("source_id", base.alias("base"), kinds.alias("address"))
    return t.select("source_id", "address", relations.resolved(c("address"), c("base")).alias("resolved"))


def linked_pages(spark, sf):
    """A page of each extraction that points to feeds, an AMP rendering and further pages."""
    head = '<link rel="alternate" type="application/rss+xml" href="/rss.xml"><link rel=alternate hreflang=hu href="/hu"><link href="/amp/1" rel="amphtml">'
    body = '<a href="/feed/">Feed</a><a href="/feedback/rss">No</a><a rel="next" href="/list?page=2">2</a><a href="https://other.example/page/2">Older</a><a href="/list?page=2">again</a>'
    return table(spark, sf, "article_extractions").select("extraction_id", "resolved_url", F.concat(F.lit("<head>" + head + "</head><p>"), F.regexp_replace(F.coalesce("title", F.lit("")), "<", "&lt;"), F.lit("</p>" + body)).alias("html"))


@query(
    """SELECT extraction_id, unnest(['declared_feed', 'amp', 'anchor_feed', 'next_page']) AS kind, regexp_extract(resolved_url, '^[A-Za-z]+://[^/?#]+') || unnest(['/rss.xml', '/amp/1', '/feed/', '/list?page=2']) AS url
    FROM article_extractions WHERE regexp_matches(resolved_url, '^[A-Za-z]+://[^/?#]')"""
)
def page_relations(spark, sf):
    return relations.page_relations(linked_pages(spark, sf), "extraction_id", "html", "resolved_url").select("extraction_id", "kind", "url")


@query(
    """SELECT source_id, unnest(['/f1', '/f2']) AS target, unnest(['application/rss+xml', 'application/feed+json']) AS type FROM sources"""
)
def header_feeds(spark, sf):
    header = F.lit('</f1>; rel="alternate"; type="application/rss+xml", </x>; rel=preload; type="text/css", </f2>; REL=alternate; Type=application/feed+json; title="a, b", </h>; rel="alternate"; hreflang="hu"')
    return table(spark, sf, "sources").select("source_id", F.inline(relations.header_feeds(header)))
