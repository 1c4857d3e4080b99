"""Queries on texts and dates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, bodies
from ..session import table

QUERIES, ORACLE = {}, {}

#: The clock of queries that ask for one (a fixed value, so that both engines answer alike).
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BOILER = "|".join(f"(?:{p})" for p in T.BOILERPLATE_LINES).replace("'", "''")
_WS = r"[ \t\n\r]+"


@query(
    r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description, '(?is)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM feed_items"""
)
def strip_html(spark, sf):
    return table(spark, sf, "feed_items").select("item_id", T.strip_html(F.col("description")).alias("text"))


@query(
    r"""SELECT extraction_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace(body_text, chr(13) || chr(10), chr(10)), '[\t ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM article_extractions"""
)
def collapse_ws(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", T.collapse_whitespace(F.col("body_text")).alias("text"))


@query(f"SELECT extraction_id, array_to_string(list_filter(string_split(body_text, chr(10)), lambda x: NOT regexp_matches(lower(trim(x)), '{_BOILER}')), chr(10)) AS text FROM article_extractions")
def boilerplate_lines(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", T.without_boilerplate_lines(F.col("body_text")).alias("text"))


_MEANINGFUL = r"""length(trim(p)) >= 20 AND length(regexp_replace(trim(p), '[^\p{L}\p{N}]', '', 'g')) >= 0.4 * length(trim(p)) AND
    CASE WHEN regexp_matches(p, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]') THEN length(regexp_replace(trim(p), '[^\p{L}\p{N}]', '', 'g')) >= 12 ELSE len(regexp_split_to_array(trim(p), '[ \t\n\r]+')) >= 4 END"""


@query(f"SELECT extraction_id, len(list_filter(string_split(body_text, chr(10)), lambda p: {_MEANINGFUL})) AS n_meaningful, len(string_split(body_text, chr(10))) AS n_lines FROM article_extractions")
def meaningful_paragraphs(spark, sf):
    lines = F.split("body_text", "\n")
    return table(spark, sf, "article_extractions").select(
        "extraction_id", F.when(F.col("body_text").isNotNull(), F.size(F.filter(lines, T.is_meaningful))).alias("n_meaningful"), F.when(F.col("body_text").isNotNull(), F.size(lines)).alias("n_lines")
    )


@query(
    r"""SELECT doc_id, (n >= 3 AND c >= 500) OR (n >= 2 AND c >= 800) OR (n >= 1 AND c >= 1200) AS usable FROM
    (SELECT doc_id, length(text) AS c, len(list_filter(regexp_split_to_array(text, '\n{2,}'), lambda p: trim(p) <> '')) AS n FROM documents WHERE text IS NOT NULL)"""
)
def usable_body(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.is_usable_body(F.col("text")).alias("usable"))


@query(r"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[ \t\n\r]|$', ' ', 'g'), '[.!?]+ |[。！？؟…]+')) AS n, length(trim(text)) >= 400 AND len(regexp_extract_all(regexp_replace(text, '[ \t\n\r]|$', ' ', 'g'), '[.!?]+ |[。！？؟…]+')) >= 3 AS substantial FROM documents WHERE text IS NOT NULL")
def sentence_count(spark, sf):
    n = T.sentence_ends(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", n.alias("n"), ((F.length(F.trim("text")) >= 400) & (n >= 3)).alias("substantial"))


_W = "list_filter(list_distinct(regexp_split_to_array(lower(trim({c})), '[ \\t\\n\\r]+')), lambda w: length(w) >= {n})"
_X, _Y = _W.format(c="title", n=3), _W.format(c="excerpt", n=3)


@query(f"SELECT extraction_id, CASE WHEN least(len({_X}), len({_Y})) > 0 THEN round(len(list_intersect({_X}, {_Y})) / least(len({_X}), len({_Y})), 6) ELSE 0 END AS overlap FROM article_extractions WHERE title IS NOT NULL AND excerpt IS NOT NULL")
def word_overlap(spark, sf):
    t = table(spark, sf, "article_extractions").where("title is not null and excerpt is not null")
    return t.select("extraction_id", T.word_overlap(F.col("title"), F.col("excerpt")).alias("overlap"))


_BX, _BY = _W.format(c="body_text", n=0), _W.format(c="excerpt", n=0)


@query(
    f"""SELECT extraction_id, coalesce(length(b) > 0 AND length(e) > 0 AND (b = e OR (length(b) > 20 AND length(e) > 20 AND starts_with(b, e) AND length(b) < length(e) * 1.5) OR (length(b) > 20 AND length(e) > 20 AND starts_with(e, b) AND length(b) > length(e) * 0.7)
    OR (length(b) <= 2 * length(e) AND len({_BX}) >= 5 AND len({_BY}) >= 5 AND len(list_intersect({_BX}, {_BY})) > 0.85 * least(len({_BX}), len({_BY})))), false) AS same
    FROM (SELECT *, lower(trim(body_text)) AS b, lower(trim(excerpt)) AS e FROM article_extractions)"""
)
def body_excerpt(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", T.body_is_excerpt(F.col("body_text"), F.col("excerpt")).alias("same"))


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN t > 0 AND 2000 - t - 1 > 1000 THEN left(h, 2000 - t - 1) ELSE h END AS capped
    FROM (SELECT doc_id, text, left(text, 2000) AS h, strpos(reverse(left(text, 2000)), chr(10) || chr(10)) AS t FROM documents)"""
)
def cap_body(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cap_body(F.col("text"), 2000).alias("capped"))


@query("SELECT item_id, sha256(array_to_string(list_filter([coalesce(trim(title), ''), coalesce(trim(link), ''), coalesce(trim(description), '')], lambda x: x <> ''), '|')) AS content_hash FROM feed_items")
def content_hash(spark, sf):
    return table(spark, sf, "feed_items").select("item_id", T.content_hash(F.col("title"), F.col("link"), F.col("description")).alias("content_hash"))


@query(r"SELECT extraction_id, left(trim(regexp_replace(regexp_replace(regexp_replace(body_text, '<[^>]*>', ' ', 'g'), '[\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g')), 240) AS preview, length(trim(body_text)) AS body_length, body_text IS NOT NULL AS has_body FROM article_extractions")
def body_preview(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", T.preview(F.col("body_text")).alias("preview"), F.length(F.trim("body_text")).alias("body_length"), F.col("body_text").isNotNull().alias("has_body"))


@query(
    r"""SELECT DISTINCT selector, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(selector, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9]+)', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))) AS tokens FROM container_candidates"""
)
def tokenize_class(spark, sf):
    t = table(spark, sf, "container_candidates").select("selector").distinct()
    return t.select("selector", F.array_sort(T.class_tokens(F.col("selector"))).alias("tokens"))


@query()
def normalize_text(spark, sf):
    """Titles as a reader should see them."""
    return table(spark, sf, "feed_items").where("title is not null").select("item_id", T.normalize_text(F.col("title")).alias("title"))


@query()
def normalize_text_detailed(spark, sf):
    """Titles with what was done to them: flags and a suspicion score."""
    return table(spark, sf, "feed_items").select("item_id", T.normalize_text_detailed(F.col("title")).alias("t")).select("item_id", "t.*")


@query(r"SELECT doc_id, coalesce(length(trim(text)) >= 400 AND len(regexp_extract_all(regexp_replace(trim(text), '[ \t\n\r]|$', ' ', 'g'), '[.!?]+ |[。！？؟…]+')) >= 3, false) AS substantial FROM documents")
def substantial_body(spark, sf):
    return table(spark, sf, "documents").select("doc_id", access.is_substantial(F.col("text")).alias("substantial"))


def _signal(code: str, column: str) -> str:
    return f"regexp_matches(lower(coalesce({column}, '')), '" + "|".join(f"(?:{p})" for p in access.INTERSTITIAL[code]) + "')"


_BOTH = " AND ".join(_signal(k, "body_text") for k in access.INTERSTITIAL)


@query("SELECT extraction_id, list_filter([" + ", ".join(f"CASE WHEN {_signal(k, 'body_text')} THEN '{k}' END" for k in access.INTERSTITIAL) + "], lambda x: x IS NOT NULL) AS signals FROM article_extractions")
def interstitial_signals(spark, sf):
    return table(spark, sf, "article_extractions").select("extraction_id", access.interstitial_signals(F.col("body_text")).alias("signals"))


@query(
    f"""SELECT extraction_id, usable, coalesce(trim(title), '') <> '' AND coalesce(trim(resolved_url), '') <> '' AND usable AS publishable
    FROM (SELECT *, coalesce(length(trim(body_text)) >= 500 AND NOT ({_BOTH}), false) AS usable FROM article_extractions)"""
)
def publishable(spark, sf):
    col = F.col
    return table(spark, sf, "article_extractions").select("extraction_id", access.is_usable(col("body_text")).alias("usable"), access.is_publishable(col("title"), col("resolved_url"), col("body_text")).alias("publishable"))


@query(
    r"""SELECT extraction_id, b > 0 AND (a = 0 OR (a < 500 AND b >= 800) OR (nb >= na + 3 AND b >= a * 1.15) OR (b >= a * 1.5 AND nb >= na)) AS prefers_page FROM
    (SELECT extraction_id, coalesce(length(excerpt), 0) AS a, coalesce(length(body_text), 0) AS b, CASE WHEN excerpt IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(excerpt, '\n{2,}'), lambda p: trim(p) <> '')) END AS na,
    CASE WHEN body_text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(body_text, '\n{2,}'), lambda p: trim(p) <> '')) END AS nb FROM article_extractions)"""
)
def body_choice(spark, sf):
    """Whether the page's text takes the place of the excerpt, by the rule for a challenger of a body."""
    a, b = F.col("excerpt"), F.col("body_text")
    return table(spark, sf, "article_extractions").select("extraction_id", bodies.prefers(a, bodies.n_paragraphs(a), b, bodies.n_paragraphs(b)).alias("prefers_page"))


@query()
def repair_mojibake(spark, sf):
    t = table(spark, sf, "feed_items").select("item_id", "title").where(F.col("title").rlike("[ÃÂÅâ]"))
    return t.select("item_id", "title", T.repair_mojibake("title").alias("repaired")).where("title <> repaired")


_FRESH = f"""CASE WHEN published_at IS NULL THEN 'missing_published_at' WHEN published_at > TIMESTAMP '{NOW}' THEN 'future_published_at'
    WHEN TIMESTAMP '{NOW}' - published_at > INTERVAL 7 DAY THEN 'outside_retention_window' END"""


@query(f"SELECT doc_id, {_FRESH} AS reason FROM (SELECT doc_id, CAST(published_at AS TIMESTAMP) AS published_at FROM documents)")
def retention_reason(spark, sf):
    """Why a document isn't fresh at NOW; null if it is."""
    now, p = F.lit(NOW).cast("timestamp"), F.col("published_at").cast("timestamp")
    why = F.when(p.isNull(), "missing_published_at").when(p > now, "future_published_at").when(p < now - F.expr("INTERVAL 7 DAYS"), "outside_retention_window")
    return table(spark, sf, "documents").select("doc_id", why.alias("reason"))


@query(f"SELECT source, count(*) AS n FROM documents WHERE CAST(published_at AS TIMESTAMP) BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}' GROUP BY source")
def retention_filter(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return table(spark, sf, "documents").where(F.col("published_at").cast("timestamp").between(now - F.expr("INTERVAL 7 DAYS"), now)).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'hu' THEN strftime(CAST(published_at AS TIMESTAMP), '%Y.%m.%d.') WHEN 'en' THEN strftime(CAST(published_at AS TIMESTAMP), '%d/%m/%Y') ELSE strftime(CAST(published_at AS TIMESTAMP), '%Y-%m-%d') END AS shown, source || ':' || strftime(CAST(published_at AS TIMESTAMP), '%Y-%m-%d') AS digest_key FROM documents")
def format_date(spark, sf):
    p, lang = F.col("published_at").cast("timestamp"), F.col("lang")
    day = F.date_format(p, "yyyy-MM-dd")
    shown = F.when(lang == "hu", F.date_format(p, "yyyy.MM.dd.")).when(lang == "en", F.date_format(p, "dd/MM/yyyy")).otherwise(day)
    return table(spark, sf, "documents").select("doc_id", shown.alias("shown"), F.concat("source", F.lit(":"), day).alias("digest_key"))


@query(
    """SELECT event_id, least(86400000, greatest(30000, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN CAST(raw AS BIGINT) * 1000 ELSE 900000 END)) AS delay_ms, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN 'delta_seconds' ELSE 'fallback' END AS kind
    FROM (SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) ELSE event_type END AS raw FROM events)"""
)
def retry_after(spark, sf):
    """A Retry-After value in seconds, bounded to between 30 seconds and a day, 15 minutes where there is none."""
    raw = F.when(F.col("event_type").isin("error", "signup"), F.floor(F.col("value") * 10).cast("bigint").cast("string")).otherwise(F.col("event_type"))
    seconds = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint"))
    delay = F.least(F.lit(86_400_000), F.greatest(F.lit(30_000), F.coalesce(seconds * 1000, F.lit(900_000))))
    return table(spark, sf, "events").select("event_id", delay.alias("delay_ms"), F.when(seconds.isNotNull(), "delta_seconds").otherwise("fallback").alias("kind"))
