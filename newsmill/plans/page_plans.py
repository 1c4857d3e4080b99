"""Queries on structured data, access and containers of pages, and the remaining joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import access, bodies
from ..session import table
from ..sources import structured
from .source_plans import _ONE
from .url_plans import PATH, PORT, parts_sql

QUERIES, ORACLE = {}, {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def structured_pages(spark, sf):
    """A page of each extraction: its article as JSON-LD in a graph, a breadcrumb, a broken script and page state."""
    t = table(spark, sf, "article_extractions")
    node = F.struct(F.array(F.lit("schema:NewsArticle"), F.lit("Article")).alias("@type"), c("title").alias("headline"), c("resolved_url").alias("url"), c("published_at").alias("datePublished"), F.array(F.struct(c("author").alias("name"))).alias("author"))
    crumb = F.struct(F.lit("BreadcrumbList").alias("@type"))
    ld = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(node).alias("@graph"), crumb.alias("x")))
    entry = F.struct(F.concat(F.lit("/s/"), c("extraction_id").cast("string")).alias("slug"), F.lit("Next").alias("title"))
    state = F.to_json(F.struct(F.struct(F.struct(F.array(entry, entry).alias("stories")).alias("pageProps")).alias("props")))
    safe = lambda x: F.replace(x, F.lit("</"), F.lit("<\\/"))
    html = F.concat(F.lit("<script type='application/ld+json'>\n"), safe(ld), F.lit('</script><SCRIPT TYPE="application/ld+json">{broken</SCRIPT><script type="application/ld+json"> </script><script id="__NEXT_DATA__">'), safe(state), F.lit("</script>"))
    return t.select("extraction_id", "resolved_url", html.alias("html"))


@query("SELECT extraction_id, CAST(2 AS INT) AS n_blocks, true AS has_state FROM article_extractions")
def page_script_blocks(spark, sf):
    return structured_pages(spark, sf).select("extraction_id", F.size(structured.script_blocks(c("html"))).alias("n_blocks"), structured.next_data(c("html")).isNotNull().alias("has_state"))


def _some(column: str) -> str:
    return f"CASE WHEN {_ONE.format(column)} IS NOT NULL THEN {column} END"


@query(
    rf"""SELECT extraction_id, 0 AS ord, regexp_replace(resolved_url, '#$', '') AS url, {_some("title")} AS headline, {_some("published_at")} AS published_at, {_some("author")} AS author, 'NewsArticle' AS type FROM article_extractions
    UNION ALL SELECT extraction_id, 1, regexp_extract(resolved_url, '^[A-Za-z]+://[^/?#]+') || '/s/' || extraction_id, 'Next', NULL, NULL, 'NextData' FROM article_extractions"""
)
def jsonld_articles(spark, sf):
    return structured.page_articles(structured_pages(spark, sf), "extraction_id", "html", "resolved_url")


@query(
    """SELECT extraction_id, CASE extraction_id % 4 WHEN 0 THEN 'isAccessibleForFree:false' ELSE 'PaywalledContent' END AS code, CASE extraction_id % 4 WHEN 0 THEN 'matched' ELSE 'unstated' END AS state
    FROM article_extractions WHERE regexp_matches(resolved_url, '^https?://[a-z0-9.-]+/') AND extraction_id % 4 < 2"""
)
def jsonld_paywall(spark, sf):
    """Walls that pages declare: of the page itself, of one nameless article, of another page, and none at all."""
    k = c("extraction_id") % 4
    node = F.struct(
        F.lit("NewsArticle").alias("@type"), F.when(k == 0, c("resolved_url")).when(k == 2, F.lit("https://other.example/x")).alias("url"), F.when(k.isin(0, 2), False).when(k == 3, True).alias("isAccessibleForFree"),
        F.when(k == 1, F.array(F.struct(F.lit("PaywalledContent").alias("@type")))).alias("hasPart"),
    )
    html = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), F.replace(F.to_json(node), F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    t = table(spark, sf, "article_extractions").where(c("resolved_url").rlike("^https?://[a-z0-9.-]+/")).select("extraction_id", "resolved_url", html.alias("html"))
    return structured.page_walls(t, "extraction_id", "html", "resolved_url").select("extraction_id", "code", "state")


def _signal_sql(kind: str, column: str) -> str:
    return "regexp_matches(lower(coalesce(" + column + ", '')), '" + "|".join(f"(?:{p})" for p in access.KINDS[kind]).replace("'", "''") + "')"


@query("SELECT extraction_id, " + ", ".join(f"{_signal_sql(k, 'body_text')} AS {k}" for k in access.KINDS) + " FROM article_extractions")
def access_signals(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", *[access.signal(c("body_text"), k).alias(k) for k in access.KINDS])


_ENDS = r"len(regexp_extract_all(regexp_replace(trim(body_text), '[ \t\n\r]|$', ' ', 'g'), '[.!?]+ |[。！？؟…]+'))"
_CHALLENGES = " + ".join("CAST(regexp_matches(lower(coalesce(body_text, '')), '" + p.replace("'", "''") + "') AS INT)" for p in access.CHALLENGES)


@query(
    f"""SELECT extraction_id, access_class, confidence, CASE WHEN access_class = 'PAYWALL_BLOCKED' THEN true WHEN access_class IN ('ACCESSIBLE', 'METERED_OR_DECLARED') THEN false END AS paywall FROM (
    SELECT extraction_id, k[1] AS access_class, k[2] AS confidence FROM (SELECT extraction_id, CASE WHEN coalesce(status_code IN (401, 403), false) THEN ['HTTP_ACCESS_BLOCKED', 'HIGH']
    WHEN NOT usable AND challenges > 0 THEN ['INTERSTITIAL_OR_CHALLENGE', CASE WHEN challenges >= 2 THEN 'MEDIUM' ELSE 'LOW' END] WHEN NOT usable AND {_signal_sql("denial", "body_text")} THEN ['HTTP_ACCESS_BLOCKED', 'MEDIUM']
    WHEN NOT usable AND {_signal_sql("call", "body_text")} THEN ['PAYWALL_BLOCKED', 'MEDIUM'] WHEN usable THEN ['ACCESSIBLE', 'HIGH'] WHEN {_signal_sql("ad_blocker", "body_text")} THEN ['INTERSTITIAL_OR_CHALLENGE', 'LOW'] ELSE ['UNKNOWN', 'LOW'] END AS k
    FROM (SELECT *, coalesce(length(trim(body_text)) >= 400 AND {_ENDS} >= 3, false) AS usable, {_CHALLENGES} AS challenges FROM article_extractions)))"""
)
def access_class(spark, sf):
    t = table(spark, sf, "article_extractions").select("extraction_id", access.access_hint(c("status_code"), c("body_text")).alias("a"))
    return t.select("extraction_id", c("a.class").alias("access_class"), c("a.confidence").alias("confidence"), access.is_paywall(c("a.class")).alias("paywall"))


@query()
def access_evidence(spark, sf):
    """The same with the codes of the evidence."""
    return table(spark, sf, "article_extractions").select("extraction_id", access.access_hint(c("status_code"), c("body_text")).alias("a")).select("extraction_id", "a.*")


#: Path segments that name no category (fixed values).
STOP_SEGMENTS = ["category", "categories", "section", "sections", "topic", "topics", "interest", "interests", "tag", "tags", "all-about", "news"]


@query(
    f"""SELECT DISTINCT u_path AS path, list_sort(list_distinct(list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(lower(u_path), '/'), lambda x: x <> '' AND x NOT IN ({", ".join(f"'{s}'" for s in STOP_SEGMENTS)})), ' '), '[^a-z0-9]+'), lambda t: length(t) >= 3 OR regexp_matches(t, '^[0-9]+$')))) AS tokens
    FROM {parts_sql("SELECT link FROM feed_items", "link")} WHERE u_path IS NOT NULL"""
)
def category_tokens(spark, sf):
    """Tokens of a path's segments, without those that name no category."""
    t = U.with_url(table(spark, sf, "feed_items").select("link"), "link").where("u_path is not null").select(c("u_path").alias("path")).distinct()
    segments = F.filter(F.split(F.lower("path"), "/"), lambda x: (x != "") & ~x.isin(STOP_SEGMENTS))
    tokens = F.filter(F.split(F.array_join(segments, " "), "[^a-z0-9]+"), lambda x: (F.length(x) >= 3) | x.rlike("^[0-9]+$"))
    return t.select("path", F.array_sort(F.array_distinct(tokens)).alias("tokens"))


@query(
    f"""SELECT item_id, p = '/sport' OR starts_with(p, '/sport/') AS in_sport FROM (SELECT item_id, lower({PATH}) AS p FROM {parts_sql("SELECT item_id, link FROM feed_items", "link")}) WHERE p IS NOT NULL"""
)
def category_scope(spark, sf):
    t = U.with_url(table(spark, sf, "feed_items").select("item_id", "link"), "link").where("u_path is not null").withColumn("p", F.lower(U._path("u_")))
    return t.select("item_id", ((c("p") == "/sport") | c("p").startswith("/sport/")).alias("in_sport"))


#: Endings that a section's feed may have (fixed values).
FEED_SUFFIXES = ["rss/", "rss", "rss.xml", "feed.xml", "atom.xml", "index.xml", "index.rss", "feed/", "feed"]


@query(f"SELECT source_id, u_scheme || '://' || u_host || {PORT} || '/' || unnest([{', '.join(repr(s) for s in FEED_SUFFIXES)}]) AS candidate FROM {parts_sql('SELECT source_id, front_page_url FROM sources', 'front_page_url')}")
def feed_candidate_urls(spark, sf):
    t = U.with_url(table(spark, sf, "sources").select("source_id", "front_page_url"), "front_page_url")
    t = t.select("source_id", F.concat("u_scheme", F.lit("://"), "u_host", U._port("u_"), F.lit("/")).alias("root"), F.explode(F.array(*map(F.lit, FEED_SUFFIXES))).alias("s"))
    return t.select("source_id", F.concat("root", "s").alias("candidate"))


@query(
    """SELECT c.extraction_id, max_by(c.selector, (round(c.score + least(c.paragraph_count, 10) * 2 - c.link_text_ratio * 20 - coalesce(c.boilerplate_penalty, 0) * 10, 6), -c.candidate_rank)) AS selector, count(DISTINCT c.candidate_rank) AS n, max(round(c.score + least(c.paragraph_count, 10) * 2 - c.link_text_ratio * 20 - coalesce(c.boilerplate_penalty, 0) * 10, 6)) AS best
    FROM container_candidates c SEMI JOIN article_extractions e ON c.extraction_id = e.extraction_id GROUP BY c.extraction_id"""
)
def page_candidates(spark, sf):
    """The best container of each extraction by an additive score of its measures."""
    t = table(spark, sf, "container_candidates").join(table(spark, sf, "article_extractions").select("extraction_id"), "extraction_id", "left_semi")
    score = F.round(c("score") + F.least("paragraph_count", F.lit(10)) * 2 - c("link_text_ratio") * 20 - F.coalesce("boilerplate_penalty", F.lit(0.0)) * 10, 6)
    g = t.withColumn("s", score).groupBy("extraction_id").agg(F.max(F.struct("s", (-c("candidate_rank")).alias("neg"), "selector")).alias("m"), F.countDistinct("candidate_rank").alias("n"))
    return g.select("extraction_id", "m.selector", "n", c("m.s").alias("best"))


_HAS = "CASE WHEN coalesce(trim({}), '') <> '' THEN {} ELSE 0 END"


@query(
    "SELECT extraction_id, round(greatest(0.0, least(1.0, CASE WHEN n >= 2000 THEN 0.4 WHEN n >= 1000 THEN 0.3 WHEN n >= 500 THEN 0.2 ELSE 0 END + CASE WHEN n >= 3000 THEN 0.1 WHEN n >= 1500 THEN 0.05 ELSE 0 END + CASE WHEN extract_method = 'article' THEN 0.15 WHEN extract_method IS NOT NULL THEN 0.05 ELSE 0 END + "
    + " + ".join(_HAS.format(x, w) for x, w in (("title", 0.1), ("excerpt", 0.05), ("author", 0.05), ("published_at", 0.05)))
    + " - CASE WHEN coalesce(is_paywall, false) THEN 0.15 ELSE 0 END)), 6) AS confidence FROM (SELECT *, coalesce(length(body_text), 0) AS n FROM article_extractions)"
)
def page_confidence(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", bodies.confidence(*map(c, ("body_text", "extract_method", "title", "excerpt", "author", "published_at", "is_paywall"))).alias("confidence"))


@query("SELECT extraction_id, unnest(quality_signals) AS signal FROM article_extractions")
def quality_signals(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", F.explode("quality_signals").alias("signal"))


@query(
    """WITH h AS (SELECT source_id, lower(regexp_extract(link, '://([^/?#:]+)', 1)) AS host FROM feed_items), s AS (SELECT source_id, regexp_extract(front_page_url, '://([^/?#:]+)', 1) AS own, rss_feed_url FROM sources)
    SELECT s.source_id, count(DISTINCT h.host) AS hosts, count(*) FILTER (h.host = s.own) AS own_links, bool_or(s.rss_feed_url IS NOT NULL) AS has_feed FROM s LEFT JOIN h ON h.source_id = s.source_id AND h.host <> '' GROUP BY s.source_id"""
)
def scoped_source_audit(spark, sf):
    """Hosts that each source's links lead to: counted by source and host first, so no source's rows meet in one task."""
    h = table(spark, sf, "feed_items").select("source_id", F.lower(F.regexp_extract("link", "://([^/?#:]+)", 1)).alias("host")).where("host <> ''").groupBy("source_id", "host").agg(F.count("*").alias("n"))
    s = table(spark, sf, "sources").select("source_id", F.regexp_extract("front_page_url", "://([^/?#:]+)", 1).alias("own"), c("rss_feed_url").isNotNull().alias("has_feed"))
    j = s.join(h, "source_id", "left")
    return j.groupBy("source_id").agg(F.count("host").alias("hosts"), F.coalesce(F.sum(F.when(c("host") == c("own"), c("n"))), F.lit(0)).alias("own_links"), F.bool_or("has_feed").alias("has_feed"))


@query("SELECT o_custkey AS me, count(*) AS n, count(*) FILTER (o_orderkey % 1500 < o_custkey) AS incoming, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def friends_list(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(c("o_custkey").alias("me")).agg(F.count("*").alias("n"), F.count_if(c("o_orderkey") % 1500 < c("o_custkey")).alias("incoming"), F.max("o_orderdate").alias("newest"))


@query("SELECT event_id, json_merge_patch(props, '{\"seen\":true}') ->> '$.seen' AS seen, CAST(props ->> '$.k' AS INT) AS k FROM events")
def json_set(spark, sf):
    """A key set in a JSON object, the others kept."""
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("seen"), F.lit("true")))
    j = F.to_json(m)
    return table(spark, sf, "events").select("event_id", F.get_json_object(j, "$.seen").alias("seen"), F.get_json_object(j, "$.k").cast("int").alias("k"))


@query("SELECT source_id, fetched_day, n, sum(n) OVER (PARTITION BY source_id ORDER BY fetched_day) AS so_far FROM (SELECT source_id, CAST(fetched_at AS TIMESTAMP)::DATE AS fetched_day, count(*) AS n FROM feed_items GROUP BY 1, 2)")
def intake_progress(spark, sf):
    """Items by source and day with the running total: the window sees days, not items."""
    by = table(spark, sf, "feed_items").groupBy("source_id", F.to_date("fetched_at").alias("fetched_day")).agg(F.count("*").alias("n"))
    return by.withColumn("so_far", F.sum("n").over(Window.partitionBy("source_id").orderBy("fetched_day")))


@query("SELECT item_id, CASE WHEN pub_date IS NULL OR trim(pub_date) = '' THEN 'missing' WHEN regexp_matches(trim(pub_date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$') THEN 'iso' ELSE 'other' END AS kind, TRY_CAST(CASE WHEN regexp_matches(trim(pub_date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$') THEN replace(replace(trim(pub_date), 'T', ' '), 'Z', '') END AS TIMESTAMP) AS at FROM feed_items")
def parse_date(spark, sf):
    """Plain ISO instants only; the timestamps operator reads all forms."""
    p = F.trim("pub_date")
    iso = p.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z\z")
    return table(spark, sf, "feed_items").select("item_id", F.when(c("pub_date").isNull() | (p == ""), "missing").when(iso, "iso").otherwise("other").alias("kind"), F.when(iso, F.try_to_timestamp(p)).alias("at"))


def batch_dedupe(spark, sf):
    """Items kept of all, taken in order, by their address and their source's guid."""
    from ..operators.batches import first_seen

    t = table(spark, sf, "feed_items").select("item_id", F.nullif(F.trim("link"), F.lit("")).alias("l"), F.concat("source_id", F.lit("|"), F.nullif(F.trim("guid"), F.lit(""))).alias("g"))
    return first_seen(t, "item_id", ["l", "g"])


QUERIES["batch_dedupe"] = batch_dedupe
