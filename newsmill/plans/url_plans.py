"""Queries on addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def parts_sql(select: str, column: str) -> str:
    """A subquery with the parts of an address, as functions/urls.py gives them."""
    p = U.URL.replace("'", "''")
    cols = ", ".join(
        f"CASE WHEN regexp_matches({column}, '{p}') THEN {'lower' if n in ('scheme', 'host') else ''}(regexp_extract({column}, '{p}', {i})) END AS u_{n}" for i, n in enumerate(("scheme", "user", "host", "port", "path", "query"), 1)
    )
    return f"(SELECT *, {cols} FROM ({select}))"


PORT = "CASE WHEN u_port = '' OR (u_scheme = 'http' AND u_port = '80') OR (u_scheme = 'https' AND u_port = '443') THEN '' ELSE ':' || u_port END"
ANY_PORT = "CASE WHEN u_port IN ('', '80', '443') THEN '' ELSE ':' || u_port END"
PATH = "CASE WHEN regexp_replace(u_path, '/+$', '') = '' THEN '/' ELSE regexp_replace(u_path, '/+$', '') END"
RAW_PATH = "CASE WHEN u_path = '' THEN '/' ELSE u_path END"


def query_sql(pairs: str) -> str:
    return f"CASE WHEN len(list_filter({pairs}, lambda x: x <> '')) > 0 THEN '?' || array_to_string(list_filter({pairs}, lambda x: x <> ''), '&') ELSE '' END"


def _names(keys: list[str]) -> str:
    return ", ".join(f"'{k}'" for k in keys)


CLEAN = f"CASE WHEN u_scheme IN ('http', 'https') THEN u_scheme || '://' || u_host || {PORT} || {PATH} || " + query_sql(f"list_filter(string_split(u_query, '&'), lambda x: split_part(x, '=', 1) NOT IN ({_names(U.LINK_TRACKING)}))") + " END"
IDENTITY = f"CASE WHEN u_scheme IN ('http', 'https') AND u_user = '' THEN 'https://' || regexp_replace(u_host, '\\.$', '') || {ANY_PORT} || {PATH} || " + query_sql(f"list_sort(list_filter(string_split(u_query, '&'), lambda x: lower(split_part(x, '=', 1)) NOT IN ({_names(U.IDENTITY_TRACKING)})))") + " END"
LINKS = "SELECT item_id, source_id, link FROM feed_items"


@query(f"SELECT item_id, {CLEAN} AS url FROM {parts_sql(LINKS, 'link')}")
def normalize_url(spark, sf):
    return U.with_url(table(spark, sf, "feed_items").select("item_id", "link"), "link").select("item_id", U.clean_url().alias("url"))


@query(f"SELECT item_id, {IDENTITY} AS identity FROM {parts_sql(LINKS, 'link')}")
def canonical_identity(spark, sf):
    return U.with_url(table(spark, sf, "feed_items").select("item_id", "link"), "link").select("item_id", U.canonical_identity().alias("identity"))


@query(f"SELECT item_id, source_id || '|' || coalesce(category, '') || '|' || {CLEAN} AS target_key FROM {parts_sql('SELECT item_id, source_id, categories[1] AS category, link FROM feed_items', 'link')}")
def target_key(spark, sf):
    t = U.with_url(table(spark, sf, "feed_items").select("item_id", "source_id", F.get("categories", F.lit(0)).alias("category"), "link"), "link")
    return t.select("item_id", F.concat("source_id", F.lit("|"), F.coalesce("category", F.lit("")), F.lit("|"), U.clean_url()).alias("target_key"))


@query(
    """SELECT item_id, CASE WHEN g = '' OR length(g) > 2048 OR regexp_matches(g, '[\\x00-\\x1f\\x7f]') OR lower(g) IN ('null', 'none', 'undefined', 'n/a') THEN NULL ELSE source_id || chr(124) || g END AS guid_key
    FROM (SELECT item_id, source_id, regexp_replace(guid, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS g FROM feed_items)"""
)
def scoped_guid(spark, sf):
    g = F.col("g")
    t = table(spark, sf, "feed_items").select("item_id", "source_id", F.regexp_replace("guid", r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("g"))
    bad = (g == "") | (F.length(g) > 2048) | g.rlike(r"[\x00-\x1f\x7f]") | F.lower(g).isin("null", "none", "undefined", "n/a")
    return t.select("item_id", F.when(~bad, F.concat("source_id", F.lit("|"), g)).alias("guid_key"))


@query(f"SELECT u_domain AS domain, count(*) AS n FROM (SELECT CASE WHEN u_scheme IN ('http', 'https') THEN regexp_replace(u_host, '^www\\.|\\.$', '', 'g') ELSE 'unknown' END AS u_domain FROM {parts_sql(LINKS, 'link')}) GROUP BY 1")
def domain_key(spark, sf):
    t = U.with_url(table(spark, sf, "feed_items").select("link"), "link")
    return t.select(F.coalesce(U.domain_key(), F.lit("unknown")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


_FEED_ALIAS = U.FEED_ALIASES.replace("'", "''")


@query(
    f"""SELECT source_id, u_scheme || '://' || u_host || {PORT} || CASE WHEN p = '' THEN '/' ELSE p END || {query_sql("list_sort(string_split(u_query, '&'))")} AS feed_key, p <> '' AS has_path FROM
    (SELECT *, regexp_replace(regexp_replace(lower(u_path), '/$', ''), '{_FEED_ALIAS}', '/rss') AS p FROM {parts_sql("SELECT source_id, rss_feed_url FROM sources", "rss_feed_url")})"""
)
def feed_key(spark, sf):
    t = U.with_url(table(spark, sf, "sources").select("source_id", "rss_feed_url"), "rss_feed_url")
    return t.select("source_id", U.feed_key().alias("feed_key"), (F.regexp_replace(F.regexp_replace(F.lower("u_path"), r"/$", ""), U.FEED_ALIASES, "/rss") != "").alias("has_path"))


@query(
    f"""SELECT source_id, CASE WHEN u_scheme IN ('http', 'https') THEN u_scheme || '://' || regexp_replace(u_host, '^www\\.', '') || {PORT} || regexp_replace(u_path, '/+$', '') || CASE WHEN u_query = '' THEN '' ELSE '?' || u_query END END AS identity
    FROM {parts_sql("SELECT source_id, front_page_url FROM sources", "front_page_url")}"""
)
def source_identity(spark, sf):
    return U.with_url(table(spark, sf, "sources").select("source_id", "front_page_url"), "front_page_url").select("source_id", U.source_identity().alias("identity"))


_RED = f"u_scheme || '://' || u_host || {PORT} || {RAW_PATH} || " + query_sql("list_distinct(list_transform(list_filter(string_split(u_query, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1) || '=[redacted]'))").replace("list_distinct", "list_sort(list_distinct").replace("'=[redacted]'))", "'=[redacted]')))")


@query(f"SELECT item_id, {_RED} AS redacted, u_scheme || '://' || u_host || {PORT} || {RAW_PATH} AS safe FROM {parts_sql(LINKS, 'link')}")
def url_redact(spark, sf):
    t = U.with_url(table(spark, sf, "feed_items").select("item_id", "link"), "link")
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.split("u_query", "&"), lambda x: x != ""), lambda x: F.concat(F.substring_index(x, "=", 1), F.lit("=[redacted]")))))
    return t.select("item_id", F.concat(U.safe_url(), U._query(keys)).alias("redacted"), U.safe_url().alias("safe"))


def _num(p: str, i: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(link, '{p}', {i}), '') AS INT)"


_A, _B, _C = r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$|-)", r"/(\d{4})(\d{2})(\d{2})(?:/|$|-)", r"/(\d{4})/(\d{1,2})(?:/|$)"


def _real(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 2000 AND 2099 THEN TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) END"


@query(f"SELECT item_id, coalesce({_real(*[_num(_A, i) for i in (1, 2, 3)])}, {_real(*[_num(_B, i) for i in (1, 2, 3)])}, {_real(_num(_C, 1), _num(_C, 2), '1')}) AS url_date FROM feed_items WHERE link IS NOT NULL")
def url_date(spark, sf):
    return table(spark, sf, "feed_items").where("link is not null").select("item_id", U.url_date(F.col("link")).alias("url_date"))


@query(
    f"""SELECT item_id, NOT regexp_matches(lower(u_path), '{U.NO_FEED_PATH}') AND (regexp_matches(lower(u_path), '{U.FEED_PATH}') OR regexp_matches(lower(u_query), '{U.FEED_QUERY}') OR contains(lower(u_path || u_query), 'jsonfeed') OR contains(lower(u_path || u_query), 'feed+json')) AS is_feed
    FROM {parts_sql("SELECT item_id, link FROM feed_items UNION ALL SELECT NULL, rss_feed_url FROM sources", "link")}"""
)
def feed_url_filter(spark, sf):
    t = table(spark, sf, "feed_items").select("item_id", "link").unionByName(table(spark, sf, "sources").select(F.lit(None).cast("bigint").alias("item_id"), F.col("rss_feed_url").alias("link")))
    return U.with_url(t, "link").select("item_id", U.is_feed_url().alias("is_feed"))


_HOSTS = [("example.org",), ("www.News.example.",), ("localhost",), ("a.localhost",), ("printer.local",), ("db.internal",), ("10.0.0.1",), ("172.16.9.9",), ("172.32.0.1",), ("192.168.1.1",), ("169.254.0.3",), ("8.8.8.8",), ("224.0.0.1",), ("bad_host.example",), ("-a.example",), ("a..example",), ("single",)]


def host_public(spark, sf):
    """Hosts of all links, and the cases that tell."""
    links = U.with_url(table(spark, sf, "feed_items").select("link"), "link").select(F.col("u_host").alias("host")).where("host is not null")
    t = links.unionByName(spark.createDataFrame(_HOSTS, "host string")).distinct()
    return t.select("host", U.is_public_host(F.col("host")).alias("is_public"))


QUERIES["host_public"] = host_public


@query(
    f"""SELECT DISTINCT source_id, h AS host, h = f OR ends_with(h, '.' || f) OR ends_with(f, '.' || h) AS same_family FROM
    (SELECT source_id, f, u_host AS h FROM {parts_sql("SELECT i.source_id, i.link, regexp_replace(lower(regexp_extract(s.front_page_url, '://([^/?#:]+)', 1)), '^www\\.', '') AS f FROM feed_items i JOIN sources s USING (source_id)", "link")}) WHERE h IS NOT NULL"""
)
def publisher_family(spark, sf):
    s = table(spark, sf, "sources").select("source_id", F.regexp_replace(F.lower(F.regexp_extract("front_page_url", r"://([^/?#:]+)", 1)), r"^www\.", "").alias("f"))
    t = U.with_url(table(spark, sf, "feed_items").select("source_id", "link"), "link").select("source_id", F.col("u_host").alias("host")).where("host is not null").distinct()
    return t.join(s, "source_id").select("source_id", "host", U.same_family(F.col("host"), F.col("f")).alias("same_family"))


@query(
    f"""WITH t AS (SELECT item_id, regexp_replace({CLEAN}, '^https?:', '') AS bare, u_scheme FROM {parts_sql(LINKS, 'link')})
    SELECT bare AS transport_identity, count(*) AS n, count(DISTINCT u_scheme) AS schemes FROM t WHERE bare IS NOT NULL GROUP BY 1 HAVING count(DISTINCT u_scheme) > 1"""
)
def transport_identity(spark, sf):
    t = U.with_url(table(spark, sf, "feed_items").select("link"), "link").select(F.regexp_replace(U.clean_url(), "^https?:", "").alias("transport_identity"), "u_scheme").where("transport_identity is not null")
    by = t.groupBy("transport_identity", "u_scheme").agg(F.count("*").alias("n"))  # few rows a key go on
    return by.groupBy("transport_identity").agg(F.sum("n").alias("n"), F.count("*").alias("schemes")).where("schemes > 1")
