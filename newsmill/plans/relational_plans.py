"""Joins, aggregations, windows, sorts and set operations of the reading and operations views, with their SQL.

Articles are the documents; reading activity, jobs and evidence are the events.  Joins on several keys at once are
unions of semi-joins, prefix matches are equi-joins on exploded prefixes: neither becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .text_plans import NOW

QUERIES, ORACLE = {}, {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Kinds of an event as reading activity (fixed values).
ACTIONS = {"view": "IMPRESSION", "click": "CLICKED", "signup": "SHARED", "purchase": "READ_FULL", "error": "DISMISSED"}


def _action(col="event_type"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col(col))


_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"


@query("SELECT event_id % 1000 AS article_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_read FROM events GROUP BY 1")
def activity_counts(spark, sf):
    return table(spark, sf, "events").groupBy((c("event_id") % 1000).alias("article_id")).agg(F.count("*").alias("n"), F.count_if(c("event_type") == "purchase").alias("n_read"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_read, count(*) FILTER (event_type = 'error') AS n_rejected, count(*) FILTER (event_type = 'signup') AS n_shared, count(DISTINCT event_id % 1000) AS n_articles FROM events GROUP BY user_id")
def user_metrics(spark, sf):
    n = lambda k: F.count_if(c("event_type") == k)
    return table(spark, sf, "events").groupBy("user_id").agg(n("purchase").alias("n_read"), n("error").alias("n_rejected"), n("signup").alias("n_shared"), F.countDistinct(c("event_id") % 1000).alias("n_articles"))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (month(CAST(published_at AS TIMESTAMP)) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM documents WHERE year(CAST(published_at AS TIMESTAMP)) = 2023 GROUP BY source")
def user_timeline(spark, sf):
    """Documents of a year by source and month, with zeros."""
    t = table(spark, sf, "documents").where(F.year(c("published_at").cast("timestamp")) == 2023)
    by = t.withColumn("m", F.format_string("m%02d", F.month(c("published_at").cast("timestamp")))).groupBy("source").pivot("m", [f"m{m:02d}" for m in range(1, 13)])
    return by.count().na.fill(0)


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most, min_by(event_id, ts) AS first_id, max_by(event_id, ts) AS last_id FROM events GROUP BY event_type")
def stage_summary(spark, sf):
    return table(spark, sf, "events").groupBy(c("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"), F.min_by("event_id", "ts").alias("first_id"), F.max_by("event_id", "ts").alias("last_id"))


@query("SELECT event_type AS stage, count(*) FILTER (value >= 50) + count(*) FILTER (value < 50) + count(*) FILTER (value IS NULL) AS told, count(*) AS n FROM events GROUP BY event_type HAVING count(*) FILTER (value >= 50) + count(*) FILTER (value < 50) + count(*) FILTER (value IS NULL) = count(*)")
def stage_reconcile(spark, sf):
    """Stages whose dispositions sum to what was selected."""
    told = F.count_if(c("value") >= 50) + F.count_if(c("value") < 50) + F.count_if(c("value").isNull())
    return table(spark, sf, "events").groupBy(c("event_type").alias("stage")).agg(told.alias("told"), F.count("*").alias("n")).where("told = n")


@query("SELECT article_id, event_id, ts FROM (SELECT event_id % 1000 AS article_id, event_id, ts, row_number() OVER (PARTITION BY event_id % 1000, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def evidence_topn(spark, sf):
    w = Window.partitionBy("article_id", "event_type").orderBy(c("ts").desc(), c("event_id").desc())
    t = table(spark, sf, "events").withColumn("article_id", c("event_id") % 1000)
    return t.withColumn("r", F.row_number().over(w)).where("r <= 2").select("article_id", "event_id", "ts")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, n > 3 AS truncated FROM r WHERE r <= 3")
def lifecycle_topn(spark, sf):
    """The newest 3 of each target and whether there are more, from the 4 newest: no count over whole targets."""
    w = Window.partitionBy("user_id").orderBy(c("ts").desc(), c("event_id").desc())
    top = table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 4")
    return top.withColumn("truncated", F.max(c("r") == 4).over(Window.partitionBy("user_id"))).where("r <= 3").select("user_id", "event_id", "truncated")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_artifact(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id", "m.ts")


@query("SELECT doc_id, published_at FROM documents WHERE (published_at, doc_id) < (TIMESTAMPTZ '2024-02-01 00:00:00+00', 500) ORDER BY published_at DESC, doc_id DESC LIMIT 50")
def keyset_page(spark, sf):
    """A page of 50 behind a cursor of date and id."""
    at, i = F.lit("2024-02-01 00:00:00").cast("timestamp"), 500
    t = table(spark, sf, "documents").select("doc_id", "published_at")
    return t.where((c("published_at") < at) | ((c("published_at") == at) & (c("doc_id") < i))).orderBy(c("published_at").desc(), c("doc_id").desc()).limit(50)


@query("SELECT kind, name, id FROM (SELECT 'customer' AS kind, c_name AS name, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_name, s_suppkey FROM supplier) WHERE (name, id) > ('Customer#000000100', 100) ORDER BY name, id LIMIT 40")
def keyset_page_union(spark, sf):
    """A page of a stream merged from two tables in order of name."""
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), c("c_name").alias("name"), c("c_custkey").alias("id"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), c("s_name").alias("name"), c("s_suppkey").alias("id"))
    t = a.unionByName(b)
    return t.where((c("name") > "Customer#000000100") | ((c("name") == "Customer#000000100") & (c("id") > 100))).orderBy("name", "id").limit(40)


@query("SELECT doc_id, title FROM documents WHERE category = 'sport' ORDER BY published_at DESC, doc_id DESC LIMIT 20 OFFSET 20")
def dashboard_page(spark, sf):
    return table(spark, sf, "documents").where("category = 'sport'").orderBy(c("published_at").desc(), c("doc_id").desc()).offset(20).limit(20).select("doc_id", "title")


@query(
    """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, doc_id DESC) AS rn FROM documents WHERE source IS NOT NULL),
    f AS (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source)
    SELECT doc_id, source FROM d JOIN f USING (source) ORDER BY CASE WHEN rn <= 5 THEN 0 ELSE 1 END, rn, first_doc LIMIT 200"""
)
def source_diversity(spark, sf):
    """A batch of 200 by turns over the sources, at most 5 of each before the rest is filled up."""
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", "source", "published_at")
    # 200 of a source are enough for any batch of 200: the window keeps no more of a hot source.
    top = d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(c("published_at").desc(), c("doc_id").desc()))).where("rn <= 200")
    first = d.groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return top.join(first, "source").orderBy(F.when(c("rn") <= 5, 0).otherwise(1), "rn", "first_doc").limit(200).select("doc_id", "source")


@query("WITH e AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS broken FROM events) SELECT user_id, count(*) FILTER (broken = 0) AS streak FROM e GROUP BY user_id")
def unproductive_streak(spark, sf):
    """Runs since the last productive one, by target: those later than it, counted without a window."""
    t = table(spark, sf, "events")
    last = t.where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    j = t.join(last, "user_id", "left")
    return j.groupBy("user_id").agg(F.count_if(c("last").isNull() | (F.struct("ts", "event_id") > c("last"))).alias("streak"))


@query("SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) > 3 AS limited FROM events")
def rate_limit(spark, sf):
    """More than 3 requests of a user within the day before and including each."""
    t = table(spark, sf, "events").select("user_id", "event_id", "ts")
    n = F.count("*").over(Window.partitionBy("user_id").orderBy(F.unix_micros(c("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0))
    return t.select("user_id", "event_id", "ts", (n > 3).alias("limited"))


#: Articles of a page of a user's feed.
PAGE = 20


@query(
    f"""WITH subs AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 40 AS k FROM orders WHERE o_orderstatus <> 'F'), src AS (SELECT source_id, media_name, row_number() OVER (ORDER BY source_id) - 1 AS k FROM sources),
    d AS (SELECT doc_id, source, title, published_at FROM documents WHERE title IS NOT NULL AND length(trim(text)) >= 500),
    r AS (SELECT user_id, doc_id, media_name, title, row_number() OVER (PARTITION BY user_id ORDER BY published_at DESC NULLS LAST, doc_id DESC) AS rank FROM subs JOIN src USING (k) JOIN d ON d.source = src.source_id)
    SELECT user_id, CAST(rank AS INT) AS rank, doc_id, media_name, title FROM r WHERE rank <= {PAGE}"""
)
def user_feed(spark, sf):
    """The first page of every user's feed: publishable articles of the sources that they follow, newest first.  A
    page needs no more than a page of each source, so sources are cut to one before they meet their followers."""
    docs = table(spark, sf, "documents").where("title is not null and length(trim(text)) >= 500").select("doc_id", "source", "title", "published_at")
    newest = [F.desc_nulls_last("published_at"), F.desc("doc_id")]
    docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(*newest))).where(c("n") <= PAGE).drop("n")
    subs = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(c("o_custkey").alias("user_id"), (c("o_orderkey") % 40).alias("k")).distinct()
    src = table(spark, sf, "sources").select("source_id", "media_name").withColumn("k", F.row_number().over(Window.orderBy("source_id")) - 1)
    heads = docs.join(src, docs.source == src.source_id).select("k", "doc_id", "media_name", "title", "published_at")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*newest))
    return subs.join(heads, "k").withColumn("rank", rank).where(c("rank") <= PAGE).select("user_id", "rank", "doc_id", "media_name", "title")


@query(f"SELECT source, count(*) AS n FROM documents WHERE title IS NOT NULL AND length(trim(text)) >= 500 AND CAST(published_at AS TIMESTAMP) > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND CAST(published_at AS TIMESTAMP) <= TIMESTAMP '{NOW}' GROUP BY source")
def digest_count(spark, sf):
    p, now = c("published_at").cast("timestamp"), F.lit(NOW).cast("timestamp")
    return table(spark, sf, "documents").where((p > now - F.expr("INTERVAL 1 DAY")) & (p <= now) & c("title").isNotNull() & (F.length(F.trim("text")) >= 500)).groupBy("source").agg(F.count("*").alias("n"))


@query(
    """WITH k AS (SELECT item_id, batch_no, source_id, nullif(lower(trim(link)), '') AS l FROM feed_items) SELECT batch_no, count(*) AS n, count(*) FILTER (l IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k o WHERE o.l = k.l AND o.batch_no < k.batch_no)) AS fresh FROM k GROUP BY batch_no"""
)
def known_url_prefilter(spark, sf):
    """Items of each batch whose address no earlier batch had: by the first batch of each address, in one aggregation
    and one join."""
    k = table(spark, sf, "feed_items").select("batch_no", F.nullif(F.lower(F.trim("link")), F.lit("")).alias("l"))
    first = k.where("l is not null").groupBy("l").agg(F.min("batch_no").alias("first"))
    return k.join(first, "l", "left").groupBy("batch_no").agg(F.count("*").alias("n"), F.count_if(c("batch_no") == c("first")).alias("fresh"))


@query(
    """WITH f AS (SELECT item_id, source_id, batch_no, nullif(trim(link), '') AS l, nullif(trim(guid), '') AS g FROM feed_items), old AS (SELECT * FROM f WHERE batch_no < 10), new AS (SELECT * FROM f WHERE batch_no >= 10)
    SELECT item_id, CASE WHEN l IN (SELECT l FROM old WHERE l IS NOT NULL) THEN CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.l = new.l AND o.source_id = new.source_id) THEN 'same_canonical' ELSE 'syndicated_canonical' END
    WHEN EXISTS (SELECT 1 FROM old o WHERE o.g = new.g AND o.source_id = new.source_id) THEN 'same_source_guid' ELSE 'new' END AS kind FROM new"""
)
def persist_candidates(spark, sf):
    """What the second half of the batches would add to the first: new rows, and how the others repeat old ones."""
    f = table(spark, sf, "feed_items").select("item_id", "source_id", "batch_no", F.nullif(F.trim("link"), F.lit("")).alias("l"), F.nullif(F.trim("guid"), F.lit("")).alias("g"))
    old, new = f.where("batch_no < 10"), f.where("batch_no >= 10")
    links = old.where("l is not null").select("l", F.lit(True).alias("has_l")).distinct()
    own = old.where("l is not null").select("source_id", "l", F.lit(True).alias("own_l")).distinct()
    guids = old.where("g is not null").select("source_id", "g", F.lit(True).alias("has_g")).distinct()
    j = new.join(links, "l", "left").join(own, ["source_id", "l"], "left").join(guids, ["source_id", "g"], "left")
    return j.select("item_id", F.when(c("own_l"), "same_canonical").when(c("has_l"), "syndicated_canonical").when(c("has_g"), "same_source_guid").otherwise("new").alias("kind"))


_PATH_SQL = "lower(regexp_extract(link, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1))"


@query(
    f"""WITH f AS (SELECT item_id, source_id, {_PATH_SQL} AS path FROM feed_items), cats AS (SELECT DISTINCT source_id, '/' || split_part(path, '/', 2) AS prefix FROM f WHERE split_part(path, '/', 3) <> '' UNION SELECT DISTINCT source_id, '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) FROM f WHERE split_part(path, '/', 4) <> '')
    SELECT item_id, max_by(prefix, length(prefix)) AS category FROM f JOIN cats USING (source_id) WHERE path = prefix OR starts_with(path, prefix || '/') GROUP BY item_id"""
)
def category_match(spark, sf):
    """The longest category path of its source that an address lies under: prefixes exploded, then an equi-join."""
    f = table(spark, sf, "feed_items").select("item_id", "source_id", F.lower(F.regexp_extract("link", r"^[A-Za-z]+://[^/?#]+(/[^?#]*)", 1)).alias("path")).where("path <> ''")
    seg = F.split("path", "/")
    two = [F.when(F.get(seg, F.lit(i + 1)) != "", F.array_join(F.slice(seg, 1, i + 1), "/")) for i in (1, 2)]
    cats = f.select("source_id", F.explode(F.array_compact(F.array(*two))).alias("prefix")).distinct()
    bare = F.split(F.regexp_replace("path", r"/$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(seg))), lambda i: F.array_join(F.slice(seg, 1, i), "/"))
    mine = f.select("item_id", "source_id", F.explode(F.array_distinct(prefixes)).alias("prefix"))
    return mine.join(cats, ["source_id", "prefix"], "left_semi").groupBy("item_id").agg(F.max_by("prefix", F.length("prefix")).alias("category"))


@query("SELECT i.item_id, u.first_id FROM feed_items i JOIN (SELECT lower(trim(title)) AS k, source_id, min(item_id) AS first_id FROM feed_items WHERE trim(title) <> '' GROUP BY 1, 2 HAVING count(*) = 1) u ON lower(trim(i.title)) = u.k AND i.source_id = u.source_id")
def identity_backfill(spark, sf):
    """Rows whose identity is unambiguous, given it."""
    k = table(spark, sf, "feed_items").select("item_id", "source_id", F.lower(F.trim("title")).alias("k")).where("k <> ''")
    one = k.groupBy("k", "source_id").agg(F.min("item_id").alias("first_id"), F.count("*").alias("n")).where("n = 1")
    return k.join(one, ["k", "source_id"]).select("item_id", "first_id")


@query("WITH e AS (SELECT o_custkey AS a, o_orderkey % 1500 AS b, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS r FROM orders) SELECT me, other, max(r) AS status FROM (SELECT a AS me, b AS other, r FROM e UNION ALL SELECT b, a, r FROM e) WHERE me <> other GROUP BY me, other")
def connection_status(spark, sf):
    """A graph's edges seen from both ends, the strongest status of each pair."""
    r = F.when(c("o_orderstatus") == "F", 3).when(c("o_orderstatus") == "O", 2).otherwise(1)
    e = table(spark, sf, "orders").select(c("o_custkey").alias("a"), (c("o_orderkey") % 1500).alias("b"), r.alias("r"))
    both = e.select(c("a").alias("me"), c("b").alias("other"), "r").unionByName(e.select(c("b").alias("me"), c("a").alias("other"), "r"))
    return both.where("me <> other").groupBy("me", "other").agg(F.max("r").alias("status"))


@query(
    f"""SELECT source, count(*) AS n_old, count(*) FILTER (doc_id % 1000 IN (SELECT event_id % 1000 FROM events WHERE event_type = 'purchase')) AS n_protected FROM documents
    WHERE coalesce(CAST(published_at AS TIMESTAMP), TIMESTAMP '1970-01-01') < TIMESTAMP '{NOW}' - INTERVAL 90 DAY GROUP BY source"""
)
def retention_cleanup(spark, sf):
    """Old documents by source, and how many reading protects."""
    used = table(spark, sf, "events").where("event_type = 'purchase'").select((c("event_id") % 1000).alias("k"), F.lit(True).alias("used")).distinct()
    old = table(spark, sf, "documents").where(F.coalesce(c("published_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")) < F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 90 DAYS"))
    j = old.select("source", (c("doc_id") % 1000).alias("k")).join(used, "k", "left")
    return j.groupBy("source").agg(F.count("*").alias("n_old"), F.count_if(F.coalesce(c("used"), F.lit(False))).alias("n_protected"))


@query("SELECT a.item_id, b.item_id AS twin_id FROM feed_items a JOIN feed_items b ON 'https:' || substr(a.link, 6) = b.link AND a.source_id = b.source_id WHERE starts_with(a.link, 'http://')")
def http_normalization(spark, sf):
    """Addresses without encryption and their encrypted twins."""
    f = table(spark, sf, "feed_items").select("item_id", "source_id", "link").where("link is not null")
    plain = f.where(c("link").startswith("http://")).select("item_id", "source_id", F.concat(F.lit("https:"), F.expr("substr(link, 6)")).alias("link"))
    return plain.join(f.withColumnRenamed("item_id", "twin_id"), ["source_id", "link"]).select("item_id", "twin_id")


@query("SELECT s.source_id, (SELECT count(*) FROM feed_items i WHERE i.source_id = s.source_id) AS n_items, (SELECT count(*) FROM article_extractions e WHERE e.source_id = s.source_id) AS n_pages, (SELECT count(*) FROM documents d WHERE d.source = s.source_id) AS n_documents FROM sources s")
def source_relation_counts(spark, sf):
    """Counts of each source's rows in three tables: each aggregated before it is joined."""
    out = table(spark, sf, "sources").select("source_id")
    for name, key, col in (("feed_items", "source_id", "n_items"), ("article_extractions", "source_id", "n_pages"), ("documents", "source", "n_documents")):
        n = table(spark, sf, name).groupBy(c(key).alias("source_id")).agg(F.count("*").alias(col))
        out = out.join(n, "source_id", "left")
    return out.na.fill(0)


@query("SELECT lower(trim(title)) AS k, count(*) AS n, min(item_id) AS first_id, count(DISTINCT source_id) AS n_sources FROM feed_items WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_sources(spark, sf):
    """Groups that share a key, with their size and first member; members stay in place, no list is built."""
    t = table(spark, sf, "feed_items").select(F.lower(F.trim("title")).alias("k"), "item_id", "source_id").where("k <> ''")
    return t.groupBy("k").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.countDistinct("source_id").alias("n_sources")).where("n > 1")


_SCORE = "coalesce(length(trim(description)), 0) + coalesce(length(trim(title)), 0)"


@query(
    f"""WITH r AS (SELECT item_id, source_id, nullif(trim(guid), '') AS g, {_SCORE} AS score FROM feed_items), w AS (SELECT source_id, g, max_by(item_id, (score, -item_id)) AS winner FROM r WHERE g IS NOT NULL GROUP BY 1, 2)
    SELECT item_id AS loser, winner FROM r JOIN w USING (source_id, g) WHERE item_id <> winner"""
)
def merge_winner(spark, sf):
    """The winner of each identity (highest score, then smallest id) and the rows to be mapped to it."""
    score = F.coalesce(F.length(F.trim("description")), F.lit(0)) + F.coalesce(F.length(F.trim("title")), F.lit(0))
    r = table(spark, sf, "feed_items").select("item_id", "source_id", F.nullif(F.trim("guid"), F.lit("")).alias("g"), score.alias("score")).where("g is not null")
    w = r.groupBy("source_id", "g").agg(F.max(F.struct("score", (-c("item_id")).alias("neg"))).alias("m")).select("source_id", "g", (-c("m.neg")).alias("winner"))
    return r.join(w, ["source_id", "g"]).where("item_id <> winner").select(c("item_id").alias("loser"), "winner")


@query(
    """SELECT item_id, arg_min(author, (extraction_id)) FILTER (author IS NOT NULL) AS author, arg_min(image_url, extraction_id) FILTER (image_url IS NOT NULL) AS image_url, bool_or(is_paywall) AS is_paywall, min(extracted_at) AS first_seen, max(confidence) AS confidence
    FROM article_extractions WHERE item_id IS NOT NULL GROUP BY item_id"""
)
def merge_metadata(spark, sf):
    """Extractions of one item merged: first known values, any, least and most."""
    first = lambda col: F.min_by(col, F.when(c(col).isNotNull(), c("extraction_id"))).alias(col)
    t = table(spark, sf, "article_extractions").where("item_id is not null")
    return t.groupBy("item_id").agg(first("author"), first("image_url"), F.bool_or("is_paywall").alias("is_paywall"), F.min("extracted_at").alias("first_seen"), F.max("confidence").alias("confidence"))


_MAPPED = "CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END"


@query(f"SELECT {_MAPPED} AS user_id, o_orderkey % 40 AS target, bool_or(o_orderstatus <> 'F') AS active, min(o_orderdate) AS since FROM orders GROUP BY 1, 2")
def subscription_remap(spark, sf):
    """Subscriptions after users were merged: rows that meet are united."""
    user = F.when(c("o_custkey") % 10 == 3, c("o_custkey") - 1).otherwise(c("o_custkey"))
    return table(spark, sf, "orders").groupBy(user.alias("user_id"), (c("o_orderkey") % 40).alias("target")).agg(F.bool_or(c("o_orderstatus") != "F").alias("active"), F.min("o_orderdate").alias("since"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def merge_delete(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT item_id, coalesce(m.winner, i.source_id) AS source_id FROM feed_items i LEFT JOIN (SELECT country_code, source_id, min(source_id) OVER (PARTITION BY country_code) AS winner FROM sources) m USING (source_id)")
def merge_remap(spark, sf):
    """Foreign keys rewritten by a mapping."""
    m = table(spark, sf, "sources").select("source_id", F.min("source_id").over(Window.partitionBy("country_code")).alias("winner"))
    return table(spark, sf, "feed_items").join(m, "source_id", "left").select("item_id", F.coalesce("winner", "source_id").alias("source_id"))


@query("SELECT count(*) AS violations FROM article_extractions e JOIN feed_items i USING (item_id) WHERE e.source_id <> i.source_id")
def merge_guard(spark, sf):
    e = table(spark, sf, "article_extractions").select("item_id", "source_id")
    return e.join(table(spark, sf, "feed_items").select("item_id", c("source_id").alias("other")), "item_id").where("source_id <> other").agg(F.count("*").alias("violations"))


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42")
def json_path_filter(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k").try_cast("int") == 42).select("event_id")


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, min(ts) AS first_at FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def deferred_cooldowns(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


@query("WITH r AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS reason, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, reason) AS rn FROM r) SELECT event_type, sum(n) AS total, list(reason ORDER BY rn) FILTER (rn <= 5) AS top_reasons FROM t GROUP BY event_type")
def outcome_summary(spark, sf):
    """Totals by status with its five most frequent reasons."""
    r = table(spark, sf, "events").groupBy("event_type", (F.get_json_object("props", "$.k").try_cast("int") % 10).alias("reason")).agg(F.count("*").alias("n"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-c("n")).alias("neg"), "reason"))), 1, 5), lambda x: x.reason)
    return r.groupBy("event_type").agg(F.sum("n").alias("total"), top.alias("top_reasons"))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def reason_map_merge(spark, sf):
    """Histograms of reasons, merged as maps and taken apart again."""
    k = (F.get_json_object("props", "$.k").try_cast("int") % 5).alias("reason")
    t = table(spark, sf, "events").groupBy("user_id", (c("event_id") % 2).alias("half"), k).agg(F.count("*").alias("n"))
    maps = t.groupBy("user_id", "half").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("m"))
    empty = F.create_map().cast("map<int,bigint>")
    two = maps.groupBy("user_id").agg(*[F.coalesce(F.first(F.when(c("half") == h, c("m")), True), empty).alias(f"m{h}") for h in (0, 1)])
    merged = F.map_zip_with("m0", "m1", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return two.select("user_id", F.explode(merged).alias("reason", "n"))


_EVAL = "SELECT extraction_id % 2 AS split, confidence >= 0.5 AS accepted, status_code = 200 AS expected FROM article_extractions WHERE confidence IS NOT NULL AND status_code IS NOT NULL"


@query(
    f"""SELECT split, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM
    (SELECT split, count(*) FILTER (accepted AND expected) AS tp, count(*) FILTER (accepted AND NOT expected) AS fp, count(*) FILTER (NOT accepted AND expected) AS fn, count(*) FILTER (NOT accepted AND NOT expected) AS tn FROM ({_EVAL}) GROUP BY split)"""
)
def policy_eval(spark, sf):
    t = table(spark, sf, "article_extractions").where("confidence is not null and status_code is not null").select((c("extraction_id") % 2).alias("split"), (c("confidence") >= 0.5).alias("a"), (c("status_code") == 200).alias("e"))
    n = t.groupBy("split").agg(F.count_if(c("a") & c("e")).alias("tp"), F.count_if(c("a") & ~c("e")).alias("fp"), F.count_if(~c("a") & c("e")).alias("fn"), F.count_if(~c("a") & ~c("e")).alias("tn"))
    rate = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    tp, fp, fn, tn = (c(x) for x in ("tp", "fp", "fn", "tn"))
    return n.select("split", "tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("prec"), rate(tp, tp + fn).alias("recall"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"))


@query(
    f"""WITH m AS (SELECT split, avg(CASE WHEN accepted THEN 1.0 ELSE 0 END) AS accepted, avg(CASE WHEN expected THEN 1.0 ELSE 0 END) AS expected FROM ({_EVAL}) GROUP BY split), u AS (UNPIVOT m ON accepted, expected INTO NAME metric VALUE v)
    SELECT a.metric, round(b.v - a.v, 6) AS delta FROM u a JOIN u b USING (metric) WHERE a.split = 0 AND b.split = 1"""
)
def policy_eval_delta(spark, sf):
    t = table(spark, sf, "article_extractions").where("confidence is not null and status_code is not null").select((c("extraction_id") % 2).alias("split"), (c("confidence") >= 0.5).cast("int").alias("accepted"), (c("status_code") == 200).cast("int").alias("expected"))
    m = t.groupBy("split").agg(F.avg("accepted").alias("accepted"), F.avg("expected").alias("expected")).unpivot("split", ["accepted", "expected"], "metric", "v")
    return m.groupBy("metric").agg(F.round(F.sum(F.when(c("split") == 1, c("v")).otherwise(-c("v"))), 6).alias("delta"))


@query("SELECT source_id FROM feed_items WHERE batch_no < 10 INTERSECT SELECT source_id FROM feed_items WHERE batch_no >= 10")
def eval_split_overlap(spark, sf):
    t = table(spark, sf, "feed_items")
    return t.where("batch_no < 10").select("source_id").intersect(t.where("batch_no >= 10").select("source_id"))


@query("SELECT id, kind FROM (SELECT source_id AS id, 'source' AS kind FROM sources WHERE rss_status = 'ACTIVE' UNION SELECT DISTINCT source_id || '/' || category, 'category' FROM (SELECT d.source AS source_id, d.category FROM documents d SEMI JOIN sources s ON d.source = s.source_id AND s.rss_status = 'ACTIVE') WHERE category IS NOT NULL)")
def active_targets(spark, sf):
    active = table(spark, sf, "sources").where("rss_status = 'ACTIVE'").select("source_id")
    cats = table(spark, sf, "documents").where("category is not null").select(c("source").alias("source_id"), "category").distinct().join(active, "source_id", "left_semi")
    return active.select(c("source_id").alias("id"), F.lit("source").alias("kind")).unionByName(cats.select(F.concat("source_id", F.lit("/"), "category").alias("id"), F.lit("category").alias("kind"))).distinct()


@query("SELECT user_id, count(DISTINCT event_type) AS stages, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'click') AS opened, count(*) FILTER (event_type = 'purchase') AS done, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'click') THEN 'opened' ELSE 'seen' END AS terminal, len(list_filter(['view', 'click', 'signup'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) > 0 AS gap FROM events GROUP BY user_id")
def run_funnel(spark, sf):
    """Conditional counts, sets and the first terminal state by precedence, for each target."""
    any_ = lambda k: F.bool_or(c("event_type") == k)
    g = table(spark, sf, "events").groupBy("user_id").agg(
        F.collect_set("event_type").alias("set"), *[F.count_if(c("event_type") == k).alias(n) for k, n in (("view", "seen"), ("click", "opened"), ("purchase", "done"))],
        F.when(any_("purchase"), "done").when(any_("error"), "failed").when(any_("click"), "opened").otherwise("seen").alias("terminal"),
    )
    gap = F.size(F.array_except(F.array(*[F.lit(x) for x in ("view", "click", "signup")]), "set")) > 0
    return g.select("user_id", F.size("set").cast("long").alias("stages"), "seen", "opened", "done", "terminal", gap.alias("gap"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00042%' AND c_custkey <> 42 ORDER BY c_name LIMIT 10")
def user_search(spark, sf):
    return table(spark, sf, "customer").where(c("c_name").ilike("%00042%") & (c("c_custkey") != 42)).orderBy("c_name").limit(10).select("c_custkey", "c_name")


@query("SELECT extraction_id, max_by(selector, (score, -candidate_rank)) AS selector, max(score) AS score, count(DISTINCT candidate_rank) AS n FROM container_candidates GROUP BY extraction_id")
def feed_candidates(spark, sf):
    """The best candidate of each page; exact duplicate rows don't count."""
    t = table(spark, sf, "container_candidates").select("extraction_id", "candidate_rank", "selector", "score")
    g = t.groupBy("extraction_id").agg(F.max(F.struct("score", (-c("candidate_rank")).alias("neg"), "selector")).alias("m"), F.countDistinct("candidate_rank").alias("n"))
    return g.select("extraction_id", "m.selector", "m.score", "n")


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def agent_logs(spark, sf):
    return table(spark, sf, "events").orderBy(c("ts").desc(), c("event_id").desc()).limit(50).select("event_id", "event_type", "ts")


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2")
def latest_run_summary(spark, sf):
    t = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    last = t.agg(F.max("day").alias("day"))
    return t.join(F.broadcast(last), "day", "left_semi").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(event_id) AS version_id, count(*) AS version, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def validator_cache_upsert(spark, sf):
    """A table keyed by resource after all upserts: newest payload, number of versions."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("version_id"), F.count("*").alias("version"), F.max_by("value", "event_id").alias("value"))


@query(f"SELECT c.c_custkey, e.version_id FROM customer c LEFT JOIN (SELECT user_id, max(event_id) AS version_id, max(ts) AS at FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey AND e.at + INTERVAL 2 DAY > TIMESTAMP '{NOW}'")
def validator_cache_lookup(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("version_id"), F.max("ts").alias("at")).where(c("at").cast("timestamp") + F.expr("INTERVAL 2 DAYS") > F.lit(NOW).cast("timestamp"))
    return table(spark, sf, "customer").select("c_custkey").join(e, c("c_custkey") == c("user_id"), "left").select("c_custkey", "version_id")


@query("SELECT artifact_type, count(*) AS n, count(*) FILTER (status = 'CAPTURED') AS captured, sum(length(payload)) AS payload_chars FROM (SELECT event_type AS artifact_type, CASE WHEN value >= 50 THEN 'CAPTURED' ELSE 'DEFERRED' END AS status, '{\"user_id\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS payload FROM events) GROUP BY artifact_type")
def artifact_log(spark, sf):
    """Evidence rows with a JSON payload, by type."""
    payload = F.to_json(F.struct("user_id", c("event_type").alias("type")))
    t = table(spark, sf, "events").select(c("event_type").alias("artifact_type"), F.when(c("value") >= 50, "CAPTURED").otherwise("DEFERRED").alias("status"), payload.alias("payload"))
    return t.groupBy("artifact_type").agg(F.count("*").alias("n"), F.count_if(c("status") == "CAPTURED").alias("captured"), F.sum(F.length("payload")).alias("payload_chars"))
