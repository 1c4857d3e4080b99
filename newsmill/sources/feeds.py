"""Feed and sitemap bodies to rows, by regular expressions on the JVM: feeds are often no well-formed XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

ITEM = ["title", "link", "guid", "pub_date", "description", "categories"]


def _raw(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1"))


def _tag(block: Column, tag: str) -> Column:
    return F.regexp_extract(block, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _blocks(df: DataFrame, body: str, tag: str) -> DataFrame:
    blocks = F.regexp_extract_all(F.col(body), F.lit(rf"(?is)<{tag}\b.*?</{tag}>"), 0)
    return df.select(*[c for c in df.columns if c != body], F.posexplode(blocks).alias("ord", "block"))


def _finish(rows: DataFrame, keep: list[str], clean: bool, **cols: Column) -> DataFrame:
    tidy = normalize_text if clean else _raw
    out = {n: (F.filter(F.transform(c, lambda x: _raw(x)), lambda x: x != "") if n == "categories" else tidy(c)) for n, c in cols.items()}
    return rows.select(*keep, "ord", *[c.alias(n) for n, c in out.items()])


def rss_items(df: DataFrame, body: str, clean: bool = True) -> DataFrame:
    """Items of RSS bodies: the other columns of ``df``, ord (from 0) and ITEM; missing tags are empty."""
    b, keep = F.col("block"), [c for c in df.columns if c != body]
    cats = F.regexp_extract_all(b, F.lit(r"(?is)<category[^>]*>(.*?)</category>"), 1)
    return _finish(_blocks(df, body, "item"), keep, clean, title=_tag(b, "title"), link=_tag(b, "link"), guid=_tag(b, "guid"), pub_date=_tag(b, "pubDate"), description=_tag(b, "description"), categories=cats)


def atom_items(df: DataFrame, body: str, clean: bool = True) -> DataFrame:
    """Entries of Atom bodies, as rss_items(); updated before published, summary before content."""
    b, keep = F.col("block"), [c for c in df.columns if c != body]
    link = F.regexp_extract(b, r"""(?is)<link[^>]+href=["']([^"']+)["'][^>]*/?>""", 1)
    cats = F.regexp_extract_all(b, F.lit(r"""(?is)<category[^>]+(?:term|label)=["']([^"']+)["'][^>]*/?>"""), 1)
    return _finish(
        _blocks(df, body, "entry"), keep, clean, title=_tag(b, "title"), link=link, guid=_tag(b, "id"), pub_date=_first(_tag(b, "updated"), _tag(b, "published")), description=_first(_tag(b, "summary"), _tag(b, "content")), categories=cats
    )


_JSON_ITEM = "struct<title:string,url:string,external_url:string,id:string,date_published:string,date_modified:string,summary:string,content_text:string,content_html:string,tags:array<string>>"


def json_items(df: DataFrame, body: str, clean: bool = True) -> DataFrame:
    """Items of JSON Feed bodies, as rss_items(); only bodies whose version names the format."""
    keep = [c for c in df.columns if c != body]
    p = F.from_json(F.col(body), f"struct<version:string,items:array<{_JSON_ITEM}>>")
    rows = df.select(*keep, p.alias("p")).where(F.lower("p.version").contains("jsonfeed")).select(*keep, F.posexplode("p.items").alias("ord", "i"))
    i = lambda n: F.col(f"i.{n}")
    return _finish(
        rows, keep, clean, title=_first(i("title")), link=_first(i("url"), i("external_url")), guid=_first(i("id"), i("url")), pub_date=_first(i("date_published"), i("date_modified")),
        description=_first(i("summary"), i("content_text"), i("content_html")), categories=F.coalesce(i("tags"), F.array().cast("array<string>")),
    )


def feed_format(body: Column) -> Column:
    """rss, atom, json or unknown: the first format that has an item."""
    return (
        F.when(body.rlike(r"(?is)<item\b.*?</item>"), "rss")
        .when(body.rlike(r"(?is)<entry\b.*?</entry>"), "atom")
        .when(F.lower(F.get_json_object(body, "$.version")).contains("jsonfeed") & F.get_json_object(body, "$.items[0]").isNotNull(), "json")
        .otherwise("unknown")
    )


def any_items(df: DataFrame, body: str, clean: bool = True) -> DataFrame:
    """Items of bodies of any format, with the format found: each body is parsed as one format only."""
    df = df.withColumn("format", feed_format(F.col(body)))
    out = None
    for name, parse in (("rss", rss_items), ("atom", atom_items), ("json", json_items)):
        rows = parse(df.where(F.col("format") == name), body, clean)
        out = rows if out is None else out.unionByName(rows)
    return out


def looks_like_feed(body: Column) -> Column:
    """By the tags of its first 4000 characters (a feed's format stands in its head)."""
    head = F.lower(F.left(body, F.lit(4000)))
    out = F.lit(False)
    for tag in ("<rss", "<feed", "<rdf:rdf", "<channel", "<entry", "<item"):
        out = out | head.contains(tag)
    return out


def sitemap_entries(df: DataFrame, body: str) -> DataFrame:
    """(columns of ``df``, ord, loc, lastmod, is_index) of sitemap bodies: a row for each url or sitemap block, news
    dates before lastmod, the first of repeated addresses; bare locs where there is no block."""
    keep = [c for c in df.columns if c != body]
    blocks = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(?:url|sitemap)\b(?!set|index).*?</(?:url|sitemap)>"), 0)
    bare = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<loc[^>]*>.*?</loc>"), 0)
    index = F.col(body).rlike(r"(?i)<sitemapindex[\s>]")
    rows = df.select(*keep, index.alias("is_index"), F.posexplode(F.when(F.size(blocks) > 0, blocks).otherwise(bare)).alias("ord", "block"))
    b = F.col("block")
    rows = rows.select(*keep, "ord", "is_index", F.trim(_tag(b, "loc")).alias("loc"), F.nullif(F.trim(_first(_tag(b, "news:publication_date"), _tag(b, "lastmod"))), F.lit("")).alias("lastmod"))
    first = rows.where("loc <> ''").groupBy(*keep, "loc").agg(F.min(F.struct("ord", "lastmod", "is_index")).alias("m"))
    return first.select(*keep, "loc", "m.ord", "m.lastmod", "m.is_index")


def post_candidates(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ord, url, headline, published) of a CMS's list of posts as JSON (link, title or title.rendered, date): posts
    with a link, each once, in order.  Bodies that are no such list give no row."""
    post = "array<struct<link:string,title:string,date:string>>"
    t = df.select(key, F.posexplode(F.from_json(body, post)).alias("ord", "p")).where("p.link <> ''")
    headline = F.trim(F.coalesce(F.get_json_object("p.title", "$.rendered"), F.when(~F.startswith(F.col("p.title"), F.lit("{")), F.col("p.title"))))
    t = t.select(key, "ord", F.col("p.link").alias("url"), headline.alias("headline"), F.col("p.date").alias("published"))
    return t.groupBy(key, "url").agg(F.min(F.struct("ord", "headline", "published")).alias("m")).select(key, "m.ord", "url", "m.headline", "m.published")
