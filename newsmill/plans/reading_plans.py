"""Queries on candidates of sections and small readings of values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import values as V
from ..operators import discovery as D
from ..operators import url_policy as P
from ..session import table
from ..sources import feeds, sitekind
from . import discovery_plans, state_plans
from .text_plans import NOW
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


@query(f"SELECT l.item_id, coalesce(l.utility IS NULL AND l.article_like AND p.accepted, false) AS kept FROM ({discovery_plans.ORACLE['link_filter']}) l JOIN ({state_plans.ORACLE['url_policy']}) p USING (item_id)")
def sitemap_filter(spark, sf):
    """Which entries of a site's map may be articles: of its host, no utility page, accepted by the URL policy, shaped
    like an article."""
    t = discovery_plans.site_links(spark, sf)
    t = P.judged(t.withColumn("__path", U.valid_path()), "__path", "u_query")
    return t.select("item_id", F.coalesce(c("u_utility").isNull() & D.is_article_like(c("site")) & c("accepted"), F.lit(False)).alias("kept"))


_TRIMMED = "regexp_replace(u_path, '^/+|/+$', '', 'g')"


@query(
    f"""SELECT item_id, {_TRIMMED} <> '' AND (regexp_matches(u_path, '/(?:19|20)[0-9]{{2}}/[01][0-9]/[0-3][0-9](?:/|$)') OR regexp_matches({_TRIMMED}, '[0-9]{{6,}}')
    OR length(split_part({_TRIMMED}, '/', -1)) > 40 OR length(regexp_replace(split_part({_TRIMMED}, '/', -1), '[^-]', '', 'g')) > 4) AS single FROM {parts_sql("SELECT item_id, link FROM feed_items", "link")} WHERE u_path IS NOT NULL"""
)
def article_like_url(spark, sf):
    """Addresses of single articles, which can't be sources."""
    return U.with_url(table(spark, sf, "feed_items").select("item_id", "link"), "link").where("u_path is not null").select("item_id", D.is_single_article().alias("single"))


_GENERATORS = ["WordPress 6.4", "Ghost 5", "Drupal 10", "none", "Brightspot"]


@query(
    f"""SELECT extraction_id, list_filter([CASE WHEN k = 0 OR k = 3 THEN 'wordpress' END, CASE WHEN k = 1 THEN 'ghost' END, CASE WHEN k = 4 THEN 'brightspot' END, CASE WHEN k = 2 THEN 'drupal' END, CASE WHEN u_path NOT IN ('', '/') THEN 'path-scoped' END], lambda x: x IS NOT NULL) AS kinds
    FROM {parts_sql("SELECT extraction_id, extraction_id % 5 AS k, resolved_url FROM article_extractions", "resolved_url")}"""
)
def cms_fingerprint(spark, sf):
    """What system made a page, by its generator, headers and paths."""
    k = (c("extraction_id") % 5).cast("int")
    head = F.concat(F.lit("<html><META name='generator' data-x content=\""), F.get(F.array(*map(F.lit, _GENERATORS)), k), F.lit('">'), F.when(k == 3, '<img src="/WP-content/x.png">').otherwise(""))
    t = U.with_url(table(spark, sf, "article_extractions").select("extraction_id", head.alias("html"), "resolved_url"), "resolved_url")
    return t.select("extraction_id", sitekind.made_by(c("html"), F.lit(None).cast("string"), c("u_path")).alias("kinds"))


@query("SELECT item_id, trim(link) AS url, trim(title) AS headline, trim(pub_date) AS published FROM feed_items WHERE trim(link) <> ''")
def wp_rest_candidates(spark, sf):
    """A CMS's list of posts to candidates; each body names its post twice and one without a link."""
    title = F.struct(c("title").alias("rendered"))
    post = F.struct(F.trim("link").alias("link"), title.alias("title"), F.trim("pub_date").alias("date"))
    none = F.struct(F.lit("").alias("link"), F.struct(F.lit("x").alias("rendered")).alias("title"), F.lit("y").alias("date"))
    bodies = table(spark, sf, "feed_items").select("item_id", F.to_json(F.array(none, post, post)).alias("body"))
    return feeds.post_candidates(bodies, "item_id", "body").select("item_id", "url", "headline", "published")


@query("SELECT country_code AS region, regexp_replace(lower(regexp_extract(front_page_url, '://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM sources")
def regional_whitelist(spark, sf):
    """Files of allowed domains, one for each country, taken apart."""
    host = F.regexp_replace(F.lower(F.regexp_extract("front_page_url", r"://([^/?#:]+)", 1)), r"^www\.", "")
    files = table(spark, sf, "sources").groupBy("country_code").agg(F.collect_list(host).alias("domains"))
    files = files.select(F.to_json(F.struct(c("country_code").alias("region"), F.lit("2024-01-01").alias("lastUpdated"), F.size("domains").alias("sourceCount"), "domains")).alias("content"))
    return sitekind.region_domains(files, "content").select("region", "domain")


_AGE = f"TIMESTAMP '{NOW}' - CAST(published_at AS TIMESTAMP)"


@query(
    f"""SELECT doc_id, coalesce(CAST(published_at AS TIMESTAMP) >= date_trunc('day', TIMESTAMP '{NOW}'), false) AS today, coalesce({_AGE} <= INTERVAL 24 HOUR, false) AS last_24h, coalesce({_AGE} <= INTERVAL 48 HOUR, false) AS last_48h, coalesce({_AGE} <= INTERVAL 7 DAY, false) AS last_1w,
    coalesce(category IN ('world', 'sport'), false) AS tagged FROM documents"""
)
def dashboard_filter(spark, sf):
    """The windows of time that an article is in, and whether it has one of the chosen tags."""
    p, now = c("published_at").cast("timestamp"), F.lit(NOW).cast("timestamp")
    tags = F.array_compact(F.array("category"))
    return table(spark, sf, "documents").select("doc_id", *[V.in_window(p, now, k).alias(k) for k in V.WINDOWS], V.has_tag(tags, ["world", "sport"]).alias("tagged"))


_TO = f"least(CAST(published_at AS TIMESTAMP) + to_days(CAST(doc_id % 40 AS INT)), TIMESTAMP '{NOW}')"


@query(
    f"""SELECT doc_id, CASE WHEN f <= t THEN f ELSE t - INTERVAL 1 DAY END AS date_from, t AS date_to, CAST(greatest(1, ceil(epoch(t - CASE WHEN f <= t THEN f ELSE t - INTERVAL 1 DAY END) / 86400)) AS BIGINT) AS days FROM
    (SELECT doc_id, t, greatest(CAST(published_at AS TIMESTAMP) - to_days(CAST(doc_id % 200 AS INT)), t - INTERVAL 90 DAY) AS f FROM (SELECT *, {_TO} AS t FROM documents WHERE published_at IS NOT NULL))"""
)
def date_range_clamp(spark, sf):
    p, now = c("published_at").cast("timestamp"), F.lit(NOW).cast("timestamp")
    days = lambda n: F.make_dt_interval(c("doc_id") % n)
    t = table(spark, sf, "documents").where("published_at is not null").select("doc_id", V.clamped_range(p - days(200), p + days(40), now).alias("r"))
    return t.select("doc_id", "r.date_from", "r.date_to", "r.days")


@query("SELECT DISTINCT 'DAILY_DIGEST:' || o_custkey || ':' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS digest_key FROM orders")
def digest_key(spark, sf):
    """One key a user and day."""
    return table(spark, sf, "orders").select(V.digest_key(c("o_custkey"), c("o_orderdate").cast("timestamp")).alias("digest_key")).distinct()


@query("SELECT item_id, CASE WHEN regexp_matches(trim(guid), '^-?[0-9]{1,15}([.][0-9]{1,9})?$') THEN CAST(greatest(10, least(5000000, floor(CAST(trim(guid) AS DOUBLE)))) AS BIGINT) ELSE 25 END AS n FROM feed_items")
def clamp(spark, sf):
    """Whatever stands in a field as a whole number within bounds."""
    return table(spark, sf, "feed_items").select("item_id", V.bounded_number(c("guid"), 25, 10, 5_000_000).alias("n"))


@query("SELECT CASE WHEN ms < 100 THEN 'lt_100ms' WHEN ms < 1000 THEN 'lt_1s' WHEN ms < 5000 THEN 'lt_5s' WHEN ms < 30000 THEN 'lt_30s' ELSE 'gte_30s' END AS bucket, count(*) AS n FROM (SELECT value * value * 4 AS ms FROM events WHERE value IS NOT NULL) GROUP BY 1")
def duration_buckets(spark, sf):
    return table(spark, sf, "events").where("value is not null").groupBy(V.duration_bucket(c("value") * c("value") * 4).alias("bucket")).agg(F.count("*").alias("n"))
