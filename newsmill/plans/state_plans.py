"""Queries on policies and keyed state, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import url_policy as P
from ..session import table
from ..streaming import circuit
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


def _policy_sql() -> str:
    def m(p):
        return "regexp_matches(p, '" + p.replace("'", "''") + "')"

    neg = [(w, why, m(p)) for _, w, p, why in P.signals() if why]
    pos = [(w, m(p), real) for _, w, p, real in P.POSITIVE]
    total = lambda rows: " + ".join(f"CASE WHEN {hit} THEN {w} ELSE 0 END" for w, hit in rows)
    reason = "CASE " + " ".join(f"WHEN {hit} THEN '{why}'" for w, why, hit in sorted(neg, key=lambda x: x[0])) + " END"
    return f"""SELECT item_id, why IS NULL AS accepted, why AS reason FROM (SELECT item_id, CASE WHEN p IS NULL THEN 'invalid_url' WHEN p = '' THEN 'utility_path' WHEN regexp_matches(q, '{P.SEARCH}') AND NOT regexp_matches(q, '{P.NO_SEARCH}') THEN 'search_or_query_page'
    WHEN regexp_matches(q, '{P.FEED}') THEN 'feed_or_archive_path' WHEN NOT (worst = 0 OR (worst <= {P.STRONG_NEGATIVE} AND real >= {P.OVERRIDE_STRONG}) OR (worst > {P.STRONG_NEGATIVE} AND (fav >= {P.OVERRIDE} OR against + fav >= 0))) THEN {reason} END AS why
    FROM (SELECT *, {total([(w, h) for w, _, h in neg])} AS against, {total([(w, h) for w, h, _ in pos])} AS fav, {total([(w, h) for w, h, r in pos if r])} AS real, least({', '.join(f'CASE WHEN {h} THEN {w} ELSE 0 END' for w, _, h in neg)}) AS worst
    FROM (SELECT item_id, lower(regexp_replace(CASE WHEN u_scheme IN ('http', 'https') AND length(u_host) >= 3 THEN u_path END, '/+$', '')) AS p, lower(u_query) AS q FROM {parts_sql("SELECT item_id, link FROM feed_items", "link")})))"""


@query(_policy_sql())
def url_policy(spark, sf):
    t = U.with_url(table(spark, sf, "feed_items").select("item_id", "link"), "link")
    return P.judged(t.withColumn("__path", U.valid_path()), "__path", "u_query").select("item_id", "accepted", "reason")


def url_policy_signals(spark, sf):
    t = U.with_url(table(spark, sf, "article_extractions").select("extraction_id", "resolved_url"), "resolved_url")
    return t.select("extraction_id", P.with_matches(c("u_path")).alias("signals"))


QUERIES["url_policy_signals"] = url_policy_signals


def outcomes(events):
    """Responses of 40 domains from the events: errors are 429 with a wait, sign-ups 403, purchases 500, else 200."""
    e = c("event_type")
    status = F.when(e == "error", 429).when(e == "signup", 403).when(e == "purchase", 500).otherwise(200)
    wait = F.when((e == "error") & (c("event_id") % 2 == 0), F.floor(c("value") * 60).cast("double"))
    return events.select(F.concat(F.lit("d"), (c("user_id") % 40).cast("string")).alias("domain"), c("event_id").alias("id"), F.unix_timestamp(c("ts").cast("timestamp")).alias("ts"), status.alias("status"), wait.alias("wait"))


@query(
    """WITH o AS (SELECT 'd' || (user_id % 40) AS domain, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type WHEN 'error' THEN 'a' WHEN 'signup' THEN 'f' WHEN 'purchase' THEN 't' ELSE 's' END AS kind, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN floor(value * 60) END AS wait FROM events),
    r AS (SELECT *, CASE WHEN lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS new, count(*) FILTER (kind = 's') OVER w AS epoch FROM o WINDOW w AS (PARTITION BY domain ORDER BY ts, id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY domain ORDER BY ts, id) AS run FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY domain, run ORDER BY ts, id) - 1 AS before FROM g),
    u AS (SELECT *, ts + least(86400, CASE WHEN kind = 'a' THEN greatest(30, least(86400, coalesce(wait, 900))) WHEN kind = 'f' AND before + 1 >= 3 THEN 21600 END * pow(2, least(before, 3))) AS until FROM b WHERE kind = 'a' OR (kind = 'f' AND before + 1 >= 3)),
    l AS (SELECT domain, max_by(kind, (ts, id)) AS k, max_by(before, (ts, id)) AS n, max_by(epoch, (ts, id)) AS epoch FROM b GROUP BY domain), m AS (SELECT domain, epoch, max(until) AS until FROM u GROUP BY 1, 2)
    SELECT l.domain, CASE WHEN k = 'a' OR (k = 'f' AND n >= 2) THEN 'OPEN' ELSE 'CLOSED' END AS circuit, CASE WHEN k = 'a' THEN n + 1 ELSE 0 END AS n429, CASE WHEN k = 'f' THEN n + 1 ELSE 0 END AS n403, CASE WHEN k <> 's' THEN CAST(until AS BIGINT) END AS cooldown_until
    FROM l LEFT JOIN m USING (domain, epoch)"""
)
def governor_fold(spark, sf):
    return circuit.fold(outcomes(table(spark, sf, "events")))


@query("SELECT date_trunc('hour', ts) AS at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def activity_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return circuit.activity(e).select("at", "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """WITH p AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id), s AS (SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (p.last IS NULL OR (e.ts, e.event_id) > p.last)) AS runs, bool_or(event_type = 'signup' AND (p.last IS NULL OR (e.ts, e.event_id) > p.last)) AS gone, bool_or(p.last IS NOT NULL) AS ever FROM events e LEFT JOIN p USING (user_id) GROUP BY e.user_id)
    SELECT user_id, ever AND runs < 3 AND NOT gone AS productive, runs FROM s"""
)
def feed_productivity_fold(spark, sf):
    """Whether a feed still counts as productive: a productive run (purchase) proves it, three unproductive ones
    (errors) after it or a report that it is gone (sign-up) end that.  Only what came after the last proof matters, so
    no ordered fold is needed."""
    e = table(spark, sf, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    j = e.join(last, "user_id", "left")
    after = c("last").isNull() | (F.struct("ts", "event_id") > c("last"))
    s = j.groupBy("user_id").agg(F.count_if((c("event_type") == "error") & after).alias("runs"), F.max((c("event_type") == "signup") & after).alias("gone"), F.max(c("last").isNotNull()).alias("ever"))
    return s.select("user_id", (c("ever") & (c("runs") < 3) & ~c("gone")).alias("productive"), "runs")


@query("SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR")
def claims(spark, sf):
    """Claims that start a new lease: no request of the user in the six hours before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("before", F.lag("ts").over(w)).where(c("before").isNull() | (c("ts") - c("before") > F.expr("INTERVAL 6 HOURS"))).select("user_id", "event_id", "ts")
