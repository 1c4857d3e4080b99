"""Queries on feeds, sitemaps, robots files and pages, whose bodies are made of the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, bodies
from ..session import table
from ..sources import containers, feeds, pages, robots
from .url_plans import parts_sql

QUERIES, ORACLE = {}, {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cdata(name):
    return F.concat(F.lit("<![CDATA["), F.coalesce(c(name), F.lit("")), F.lit("]]>"))


def _tag(tag, value):
    return F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))


def _cats(form):
    return F.array_join(F.transform(F.coalesce("categories", F.array().cast("array<string>")), form), "")


def rss_bodies(items):
    """One RSS body for each item."""
    inner = [_tag(t, _cdata(n)) for t, n in (("title", "title"), ("link", "link"), ("guid", "guid"), ("pubDate", "pub_date"), ("description", "description"))]
    cats = _cats(lambda x: F.concat(F.lit("<category>"), x, F.lit("</category>")))
    return items.select("item_id", F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><ITEM>'), *inner, cats, F.lit("</ITEM></channel></rss>")).alias("body"))


def atom_bodies(items):
    link = F.concat(F.lit('<link rel="alternate" href="'), F.coalesce("link", F.lit("")), F.lit('"/>'))
    cats = _cats(lambda x: F.concat(F.lit('<category term="'), x, F.lit('"/>')))
    inner = [_tag("title", _cdata("title")), link, _tag("id", _cdata("guid")), _tag("updated", F.lit("")), _tag("published", _cdata("pub_date")), _tag("content", _cdata("description"))]
    return items.select("item_id", F.concat(F.lit("<feed><entry>"), *inner, cats, F.lit("</entry></feed>")).alias("body"))


def json_bodies(items):
    item = F.struct("title", c("link").alias("external_url"), c("guid").alias("id"), c("pub_date").alias("date_modified"), c("description").alias("content_text"), c("categories").alias("tags"))
    return items.select("item_id", F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.array(item).alias("items"))).alias("body"))


def _items(spark, sf):
    return table(spark, sf, "feed_items").select("item_id", "title", "link", "guid", "pub_date", "description", "categories")


_T = "trim(coalesce({}, ''))"
_CATS = "list_filter(list_transform(coalesce(categories, []), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT item_id, {_T.format('title')} AS title, {_T.format('link')} AS link, {_T.format('guid')} AS guid, {_T.format('pub_date')} AS pub_date, {_T.format('description')} AS description, {_CATS} AS categories FROM feed_items")
def feed_rss_items(spark, sf):
    return feeds.rss_items(rss_bodies(_items(spark, sf)), "body", clean=False).drop("ord")


@query(f"SELECT item_id, {_T.format('title')} AS title, {_T.format('link')} AS link, {_T.format('guid')} AS guid, {_T.format('pub_date')} AS pub_date, {_T.format('description')} AS description, {_CATS} AS categories FROM feed_items")
def feed_atom_items(spark, sf):
    return feeds.atom_items(atom_bodies(_items(spark, sf)), "body", clean=False).drop("ord")


@query(f"SELECT item_id, {_T.format('title')} AS title, {_T.format('link')} AS link, {_T.format('guid')} AS guid, {_T.format('pub_date')} AS pub_date, {_T.format('description')} AS description, {_CATS} AS categories FROM feed_items")
def feed_json_items(spark, sf):
    return feeds.json_items(json_bodies(_items(spark, sf)), "body", clean=False).drop("ord")


def _mixed(spark, sf):
    t = _items(spark, sf)
    m = c("item_id") % 3
    out = [make(t.where(m == i)) for i, make in enumerate((rss_bodies, atom_bodies, json_bodies))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT ['rss', 'atom', 'json'][item_id % 3 + 1] AS format, count(*) AS n, count(*) FILTER (trim(title) <> '') AS titled FROM feed_items GROUP BY 1")
def feed_dispatch(spark, sf):
    return feeds.any_items(_mixed(spark, sf), "body", clean=False).groupBy("format").agg(F.count("*").alias("n"), F.count_if(c("title") != "").alias("titled"))


@query("SELECT item_id % 3 < 2 AS is_xml, count(*) AS n FROM feed_items GROUP BY 1")
def feed_sniff(spark, sf):
    return _mixed(spark, sf).select(feeds.looks_like_feed(c("body")).alias("is_xml")).groupBy("is_xml").agg(F.count("*").alias("n"))


@query()
def feed_items_clean(spark, sf):
    """Items of feeds of all formats as readers see them."""
    return feeds.any_items(_mixed(spark, sf), "body")


@query("SELECT source_id, trim(link) AS loc, min(pub_date) AS lastmod FROM (SELECT source_id, link, FIRST_VALUE(nullif(trim(pub_date), '')) OVER (PARTITION BY source_id, batch_no, trim(link) ORDER BY item_id) AS pub_date, row_number() OVER (PARTITION BY source_id, batch_no, trim(link) ORDER BY item_id) AS r FROM feed_items WHERE trim(link) <> '') WHERE r = 1 GROUP BY source_id, trim(link)")
def sitemap_entries(spark, sf):
    """Sitemaps of each source and batch, read back; the least date of an address over its sitemaps."""
    url = F.concat(F.lit("<url><loc>"), "link", F.lit("</loc><lastmod>"), F.coalesce("pub_date", F.lit("")), F.lit("</lastmod></url>"))
    t = table(spark, sf, "feed_items").where("trim(link) <> ''").select("source_id", "batch_no", "item_id", url.alias("u"))
    # A sitemap holds at most 50,000 addresses by its standard, so a larger batch is several files.
    t = t.groupBy("source_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "u"))), lambda x: x.u), "").alias("urls"))
    body = t.select("source_id", "batch_no", F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>")).alias("body"))
    return feeds.sitemap_entries(body, "body").groupBy("source_id", "loc").agg(F.min("lastmod").alias("lastmod"))


_ROBOTS = """User-agent: *
Disallow: /money/
Disallow: /*?cat=
Allow: /*?cat=local
# a comment
User-agent: newsmill
User-agent: other
Disallow: /sport/
Allow: /sport/how-
Disallow: /*/amp$
"""


def robots_parse(spark, sf):
    """Rules of one robots body for every source."""
    body = table(spark, sf, "sources").select("source_id", F.lit(_ROBOTS).alias("body"))
    return robots.robots_rules(body, "source_id", "body")


QUERIES["robots_parse"] = robots_parse


@query(
    f"""SELECT source_id, allowed, count(*) AS n FROM (SELECT source_id, CASE WHEN regexp_matches(p, '(?i)^/sport/how-') THEN true WHEN regexp_matches(p, '(?i)^/sport/') THEN false WHEN regexp_matches(p, '(?i)^/.*/amp$') THEN false ELSE true END AS allowed
    FROM (SELECT source_id, CASE WHEN u_path = '' THEN '/' ELSE u_path END || CASE WHEN u_query = '' THEN '' ELSE '?' || u_query END AS p FROM {parts_sql("SELECT source_id, link FROM feed_items", "link")}) WHERE p IS NOT NULL) GROUP BY 1, 2"""
)
def robots_allowed(spark, sf):
    from ..functions import urls as U

    t = U.with_url(table(spark, sf, "feed_items").select("source_id", "link"), "link").where("u_host is not null")
    path = F.concat(F.when(c("u_path") == "", "/").otherwise(c("u_path")), F.when(c("u_query") == "", "").otherwise(F.concat(F.lit("?"), "u_query")))
    out = robots.robots_allowed(t.select(c("source_id").alias("domain"), path.alias("path")), robots_parse(spark, sf), "newsmill/1.0")
    return out.groupBy(c("domain").alias("source_id"), "allowed").agg(F.count("*").alias("n"))


def _escape(col):
    return F.replace(F.replace(F.replace(F.coalesce(c(col), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def page_bodies(spark, sf):
    """A page of each extraction: head, navigation, its lines as paragraphs of an article, footer."""
    t = table(spark, sf, "article_extractions")
    para = F.concat(F.lit("<p>"), F.replace(_escape("body_text"), F.lit("\n"), F.lit("</p><p>")), F.lit("<br></article>"))
    head = F.concat(F.lit('<html><head><title>x | y</title><meta property="og:title" content="'), _escape("title"), F.lit('"><meta name=description content="'), _escape("excerpt"), F.lit('"><link rel="canonical" href="'), _escape("resolved_url"), F.lit('"><script>var a = "</p><p>";</script></head>'))
    body = F.concat(F.lit('<body><nav><a href="/a">Home</a></nav><article>'), para, F.lit('<footer><p>About us</p></footer><p><a href="/next?x=1&amp;y=2">Next <b>page</b></a></body></html>'))
    return t.select("extraction_id", F.concat(head, body).alias("html"))


_ONE = "nullif(trim(regexp_replace({}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '')"


@query(f"SELECT extraction_id, resolved_url AS canonical_url, coalesce({_ONE.format('title')}, 'x | y') AS title, {_ONE.format('excerpt')} AS excerpt, {_ONE.format('image_url')} AS image_url, {_ONE.format('author')} AS author, {_ONE.format('published_at')} AS published_at FROM article_extractions")
def page_meta(spark, sf):
    """All metadata of pages: those of page_bodies() with image, author and date in the head."""
    t = table(spark, sf, "article_extractions")
    more = F.concat(F.lit('<meta property="og:image" content="'), _escape("image_url"), F.lit('"><meta name="author" content="'), _escape("author"), F.lit('"><meta property="article:published_time" content="'), _escape("published_at"), F.lit('">'))
    both = page_bodies(spark, sf).join(t.select("extraction_id", more.alias("more")), "extraction_id")
    return pages.page_meta(both.select("extraction_id", F.concat("more", "html").alias("html")), "extraction_id", "html")


@query()
def page_paragraphs(spark, sf):
    return pages.page_paragraphs(page_bodies(spark, sf), "extraction_id", "html")


@query("SELECT extraction_id, unnest(['/a', '/next?x=1&y=2']) AS href, unnest(['Home', 'Next page']) AS text FROM article_extractions")
def page_links(spark, sf):
    return pages.page_links(page_bodies(spark, sf), "extraction_id", "html").select("extraction_id", "href", "text")


_LINE = _ONE.format("l")
_LETTERS = r"length(regexp_replace(p, '[^\p{L}\p{N}]', '', 'g'))"


@query(
    f"""SELECT extraction_id, 'article' AS selector, count(*) AS n_paragraphs, CAST(sum(length(p)) AS BIGINT) AS text_length FROM (SELECT DISTINCT extraction_id, {_LINE} AS p FROM (SELECT extraction_id, unnest(string_split(body_text, chr(10))) AS l FROM article_extractions))
    WHERE length(p) >= 20 AND {_LETTERS} >= 0.4 * length(p) AND CASE WHEN regexp_matches(p, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}]') THEN {_LETTERS} >= 12 ELSE len(string_split(p, ' ')) >= 4 END GROUP BY 1"""
)
def page_containers(spark, sf):
    """Containers of the pages by their paragraphs and text."""
    t = containers.page_containers(page_bodies(spark, sf), "extraction_id", "html")
    return t.select("extraction_id", "selector", F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)).alias("text_length"))


def _ranked(spark, sf):
    t = containers.page_containers(page_bodies(spark, sf), "extraction_id", "html")
    return bodies.ranked(t.join(table(spark, sf, "article_extractions").select("extraction_id", "excerpt"), "extraction_id"), "extraction_id")


@query()
def page_container_scores(spark, sf):
    """Containers with scores, ranks and why one can't be the body."""
    return _ranked(spark, sf).select("extraction_id", "selector", "score", "rank", "n_paragraphs", "text_length", "refused")


@query()
def page_body(spark, sf):
    return bodies.chosen(_ranked(spark, sf), "extraction_id")


@query()
def page_extract(spark, sf):
    """Pages to articles: metadata, body, access, confidence; or the reason why a page is refused."""
    t = table(spark, sf, "article_extractions").select("extraction_id", "status_code")
    meta = pages.page_meta(page_bodies(spark, sf), "extraction_id", "html")
    all_ = t.join(meta, "extraction_id").join(page_body(spark, sf), "extraction_id", "left")
    told = all_.withColumn("a", access.access_hint(c("status_code"), c("body")))
    reason = F.when(c("a.class") == "HTTP_ACCESS_BLOCKED", "http_blocked").when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing_title").when(c("body").isNull(), F.coalesce(F.get("tried", F.lit(0)), F.lit("no_body"))).when(
        T.body_is_excerpt(c("body"), c("excerpt")), "body_is_excerpt"
    )
    sure = bodies.confidence(c("body"), c("selector"), c("title"), c("excerpt"), c("author"), c("published_at"), access.is_paywall(c("a.class")))
    return told.select("extraction_id", "canonical_url", "title", "excerpt", "author", "published_at", "body", "selector", c("a.class").alias("access_class"), sure.alias("confidence"), reason.alias("refused"))


#: Where a page's date is written, best first (fixed values); a date in the address comes before the last two.
_DATE_PLACES = pages.DATE_PLACES
_DATED = "published_at IS NOT NULL AND regexp_matches(published_at, '^[^\"''<>&]+$')"


def dated_pages(spark, sf):
    """Pages with the real date in one place, chosen by the id, and another one in all that come after it."""
    t = table(spark, sf, "article_extractions").where(c("published_at").rlike("^[^\"'<>&]+$"))
    k = c("extraction_id") % len(_DATE_PLACES)
    head = F.concat(*[F.when(k < i, F.lit(form % "later")).when(k == i, F.concat(*[F.lit(x) if j == 0 else F.concat("published_at", F.lit(x)) for j, x in enumerate((form % "\x00").split("\x00"))])).otherwise("") for i, (_, _, form) in reversed(list(enumerate(_DATE_PLACES)))])
    return t.select("extraction_id", F.concat(F.lit("<html><head>"), head, F.lit("</head></html>")).alias("html"), F.lit("https://a.example/x").alias("url"))


@query(f"SELECT extraction_id, [{', '.join(repr(s) for s, _, _ in _DATE_PLACES)}][CAST(extraction_id % {len(_DATE_PLACES)} AS INT) + 1] AS source, published_at AS raw FROM article_extractions WHERE {_DATED}")
def page_date(spark, sf):
    return dated_pages(spark, sf).select("extraction_id", pages.page_date(c("html"), c("url")).alias("d")).select("extraction_id", "d.source", "d.raw")


@query(f"""SELECT extraction_id, regexp_extract(title, '^[^"'']*') AS title, regexp_extract(excerpt, '^[^"'']*') AS description FROM article_extractions WHERE regexp_matches(title, '^[^"''<>&]+$') AND regexp_matches(excerpt, '^[^"''<>&]+$')""")
def page_meta_regex(spark, sf):
    """Metadata of listings by patterns alone, without a tree, for pages whose values need no escapes."""
    t = table(spark, sf, "article_extractions").where(c("title").rlike("^[^\"'<>&]+$") & c("excerpt").rlike("^[^\"'<>&]+$"))
    html = F.concat(F.lit("<title>none</title><meta name='twitter:title' content='no'><META  property=\"og:title\" content=\""), "title", F.lit("\"><meta property='og:description' content='no'><meta name='description' content='"), "excerpt", F.lit("'>"))
    return t.select("extraction_id", pages.meta_by_pattern(html).alias("m")).select("extraction_id", "m.title", "m.description")


@query("SELECT lang, count(*) AS n_sources, count(rss_feed_url) AS n_feeds, list(source_id ORDER BY source_id) AS ids FROM sources GROUP BY lang")
def source_catalog(spark, sf):
    """A nested catalogue (languages with their sources), taken apart again."""
    nested = table(spark, sf, "sources").groupBy("lang").agg(F.to_json(F.collect_list(F.struct("source_id", "rss_feed_url"))).alias("content"))
    flat = nested.select("lang", F.explode(F.from_json("content", "array<struct<source_id:string,rss_feed_url:string>>")).alias("s")).select("lang", "s.*")
    return flat.groupBy("lang").agg(F.count("*").alias("n_sources"), F.count("rss_feed_url").alias("n_feeds"), F.array_sort(F.collect_list("source_id")).alias("ids"))
