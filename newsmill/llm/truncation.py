"""Problem 3: texts cut off by field limits or in transfer.

Words are counted by trigrams inside sentences and at ends: of sentences, of lines and of whole texts.  A text
without a final stop whose last trigram is frequent inside but almost never at an end was cut; so was one whose last
trigram is new while the two words before are usually followed by something (a word cut in two).  Marks of omission,
torn tags, entities and addresses, a sentence begun on the line of finished ones, and, for texts without a stop, the
exact length that a source's texts pile up at, tell the rest.  Trigrams judge only ends that are prose: the last
line has words of its own, not just names, figures and marks, and isn't a headline of the corpus.

All of it is SQL: one scan that turns words to hashes, an aggregation of fixed-width keys with map-side combine, and
joins of the few texts without a stop to the counts.  Names and figures are counted as classes, so that counts are
about phrases; a text that is delivered again counts once at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, hot_join, hot_keys, small_join, table

#: A last trigram tells of a cut if it is inside texts at least INSIDE times and ends at most END_SHARE of them.
INSIDE, END_SHARE = 5, 0.1
#: The same for the two words before a last word that never follows them inside.
INSIDE_PAIR = 20
#: Words in lower case that the last line needs to be judged as prose.
PLAIN_WORDS = 3
#: A length is a source's limit if so many texts without a stop, and this share of them, have it exactly.
AT_LIMIT, AT_LIMIT_SHARE = 6, 0.08

_CLOSERS = "\"”“„»«’‘')\\]」』›"
_ENTITY_QUOTES = r"&(?:rsquo|lsquo|rdquo|ldquo|quot|raquo|laquo|bdquo|apos|#39|#34|#8216|#8217|#8220|#8221|#8222|#171|#187|#x201[89cd]);"
_OMISSION = r"(?:\[\s*(?:\.\.\.|…|&hellip;|&#8230;)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…|&hellip;|&#8230;)\s*$"
_TORN = r"(?:<[A-Za-z/!][^<>]*+|<|&#?[A-Za-z0-9]{1,8}|&#?|\bhttps?:/{0,2}|\bhttps?://[^\s./]*)$"
#: A final stop, maybe with closing marks behind it, be they garbled; or brackets that close.
_STOP = rf"[.!?。！？](?:[\"”“»’‘')\]」』›]*(?:\s»)?|[ÂâÃĂΓ‚\x80-\x9f�][^\sA-Za-z0-9.!?。]{{0,14}})$|\([^()]{{1,80}}\)$|\[[^\[\]]{{1,80}}\]$"
#: A sentence begun behind a finished one on the same line; signatures (behind a dash) and addresses are none.
_BEGUN = rf"(?:[.!?][{_CLOSERS}]*+[^\S\r\n]++|[。！？][{_CLOSERS}]*+)(?![–—|•·<-]|https?:|\s|$)[^.!?。！？\r\n|•·»{{}}]+$"
#: Words after which a line or sentence ends, as _normal() gives them.
_CLOSING = [".", "!", "?", "。", "！", "？", "¶", "(", "|"]


def _words(text: Column) -> Column:
    """Words and marks: tags gone, addresses ⌘, names N, figures 9, line ends ¶."""
    t = F.when(text.contains("<"), F.regexp_replace(text, r"</?[A-Za-z][^<>]*+>", " ")).otherwise(text)
    t = F.when(t.contains("&"), F.regexp_replace(t, _ENTITY_QUOTES, "’")).otherwise(t)
    t = F.when(t.contains("http"), F.regexp_replace(t, r"https?://\S++", " ⌘ ")).otherwise(t)
    t = F.when(t.contains("\n"), F.regexp_replace(t, r"[ \t\f]*+[\r\n]\s*+", " ¶ ")).otherwise(t)
    t = F.regexp_replace(t, r"\p{Lu}[\p{L}\p{M}’'-]*+(?:\s++\p{Lu}[\p{L}\p{M}’'-]*+)*+", "N")
    t = F.regexp_replace(t, r"([^\p{L}\p{M}\d\s’'-]|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")
    return F.split(F.trim(F.regexp_replace(t, r"\d++", "9")), r"\s++")


def _pair(words: Column, at: Column) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def texts_of(items: DataFrame, extractions: DataFrame) -> DataFrame:
    return items.select(F.lit("feed_item").alias("record_type"), F.col("item_id").alias("record_id"), "source_id", F.col("description").alias("text")).unionByName(
        extractions.select(F.lit("extraction").alias("record_type"), F.col("extraction_id").alias("record_id"), "source_id", F.col("body_text").alias("text"))
    )


def ends_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, k): how many different texts have it."""
    return rows.groupBy(key, "same").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("*").alias("k"))


def _shape(text: Column) -> Column:
    """A headline but for its names and figures."""
    t = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"\p{Lu}\p{Ll}[\p{L}\p{M}’'-]*+(?:\s++\p{Lu}\p{Ll}[\p{L}\p{M}’'-]*+)*+", "N")
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"\d++", "9"), r"[\s\u00a0]+", " "))))


def truncated(texts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(record_type, record_id, source_id, cut boolean, why) of (record_type, record_id, source_id, text).

    One row for each row; null, empty and blank texts and texts of one or two words without a mark are not cut; rows
    that come again get the same answer each time.  ``titles`` (title): headlines of the corpus, which are whole.
    Extra columns are ignored.
    """
    text = F.col("text")
    t = texts.select("record_type", "record_id", "source_id", F.rtrim(text, F.lit(" \t\r\n\f\u00a0\u3000")).alias("text"))
    # Inside: all trigrams but the last, as the hash of two words and that of the third, whose lowest bit tells that a
    # sentence or line ends behind it.
    w, n = F.col("words"), F.col("n")
    closes = lambda i: F.get(w, i + 3).isin(*_CLOSING).cast("bigint")
    third = lambda i: F.shiftleft(F.xxhash64(F.get(w, i + 2)), 1)
    gram = lambda i: F.struct(_pair(w, i).alias("h2"), third(i).bitwiseOR(closes(i)).alias("h1"))
    # explode(array(x)) keeps the words from being made anew for each use of them.
    grams = t.select(F.explode(F.array(_words(text))).alias("words")).withColumn("n", F.size("words")).where("n >= 4")
    grams = grams.select(F.explode(F.transform(F.sequence(F.lit(0), n - 4), gram)).alias("g")).groupBy("g.h2", "g.h1").agg(F.count("*").alias("k"))
    open_bit = F.col("h1").bitwiseAND(1)
    inside = grams.groupBy("h2", F.shiftright("h1", 1).alias("h3")).agg(F.sum(F.col("k") * (1 - open_bit)).alias("inside"), F.sum(F.col("k") * open_bit).alias("closed"))
    inside = cut(inside)
    follows = inside.groupBy("h2").agg(F.sum(F.col("inside") + F.col("closed")).alias("follows"))
    # The end: flags see the last line, the last trigram of a text without a stop its last three lines (they hold three
    # words).
    t = t.select(
        "record_type", "record_id", "source_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("same"), F.when(F.length("text") < 200, _shape(F.col("text"))).alias("shape"),
        F.substring_index("text", "\n", -1).alias("line"), F.substring_index("text", "\n", -3).alias("tail"),
    )
    line = F.col("line")
    t = t.withColumn("bare", F.when(line.endswith(">"), F.regexp_replace(line, r"(?:\s*+</?[A-Za-z][^<>]*+>)+$", "")).otherwise(line))
    bare = F.col("bare")
    t = t.withColumns({
        "marked": bare.rlike(_OMISSION), "torn": line.rlike(_TORN), "stopped": F.when(bare.contains("&"), F.regexp_replace(bare, _ENTITY_QUOTES, "”")).otherwise(bare).rlike(_STOP),
        "begun": bare.rlike(_BEGUN), "plain": F.regexp_count(line, F.lit(r"(?<!\p{L})\p{Ll}{2,}")) >= PLAIN_WORDS, "figure": bare.rlike(r"\d[\p{L}\d]*$"),
    })
    is_open = ~F.col("stopped") & ~F.col("marked") & ~F.col("torn")
    t = t.select("*", F.explode(F.array(F.when(is_open, _words(F.col("tail"))))).alias("words")).withColumn("n", F.size("words"))
    last = t.select(
        "record_type", "record_id", "source_id", "n_chars", "n_bytes", "same", "marked", "torn", "stopped", "begun", "figure", "shape",
        (F.col("plain") & F.exists(F.slice(w, F.greatest(n - 2, F.lit(1)), 3), lambda x: x.rlike(r"^\p{Ll}|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))).alias("prose"),
        F.when(n >= 3, _pair(w, n - 3)).alias("h2"), F.when(n >= 3, F.shiftright(F.shiftleft(F.xxhash64(F.get(w, n - 1)), 1), 1)).alias("h3"),
        (F.get(w, n - 1) == "⌘").alias("address"), F.xxhash64(F.substring_index("line", " ", -1)).alias("tail"),
    )
    last = cut(last)
    open_ = last.where("not stopped and not marked and not torn")
    bases = open_  # a filter of what is materialised; the joins below are run once, at the end
    ends = bases.select("h3", "h2", "same").distinct()
    by3 = ends.where("h3 is not null").groupBy("h2", "h3").agg(F.count("*").alias("ends")).join(inside, ["h2", "h3"], "left")
    by2 = ends.where("h2 is not null").groupBy("h2").agg(F.count("*").alias("ends2")).join(follows, "h2", "left")
    sizes = cut(bases.groupBy("h2", "h3").agg(F.count("*").alias("n")))
    open_ = hot_join(open_, by3, ["h2", "h3"], "record_id", hot_keys(sizes, ["h2", "h3"]))
    open_ = hot_join(open_, by2, ["h2"], "record_id", hot_keys(sizes.groupBy("h2").agg(F.sum("n").alias("n")), ["h2"]))
    # Limits of a source: lengths that texts without a stop pile up at; sources x lengths rows at most.
    known = []
    for unit in ("n_chars", "n_bytes"):
        sizes = last.where(f"not stopped and not marked and {unit} >= 40").select("record_type", "source_id", unit, "same").distinct()
        sizes = sizes.groupBy("record_type", "source_id", unit).agg(F.count("*").alias("here"))
        all_ = sizes.groupBy("record_type", "source_id").agg(F.sum("here").alias("all"))
        piles = sizes.join(all_, ["record_type", "source_id"]).where((F.col("here") >= AT_LIMIT) & (F.col("here") >= AT_LIMIT_SHARE * F.col("all")))
        known.append(piles.select("record_type", "source_id", unit, F.lit(True).alias(f"at_{unit}")))
    for unit, limits in zip(("n_chars", "n_bytes"), known):
        open_ = small_join(open_, limits, ["record_type", "source_id", unit], "record_id")
    if titles is not None:
        heads = titles.where("title is not null").select(_shape(F.col("title")).alias("shape")).distinct().withColumn("headline", F.lit(True))
        open_ = small_join(open_, heads, ["shape"], "record_id")
    else:
        open_ = open_.withColumn("headline", F.lit(None).cast("boolean"))
    c = F.col
    inside_n, closed_n, ends_n = (F.coalesce(c(x), F.lit(0)) for x in ("inside", "closed", "ends"))
    pair_n, pair_ends = F.coalesce(c("follows"), F.lit(0)), F.coalesce(c("ends2"), F.lit(0))
    may_end = closed_n + ends_n
    phrase = (inside_n >= INSIDE) & (may_end <= END_SHARE * (may_end + inside_n))
    torn_word = (inside_n + closed_n < INSIDE) & (ends_n < INSIDE) & (pair_n >= INSIDE_PAIR) & (pair_ends <= END_SHARE * (pair_ends + pair_n))
    # An address that ends texts again and again is a footer; another one at the limit was cut.
    footers = ends_of(bases.where("address"), "tail").where(F.col("k") >= INSIDE).select("tail", F.lit(True).alias("footer"))
    open_ = small_join(open_, footers, ["tail"], "record_id")
    limit = F.coalesce(c("at_n_chars"), c("at_n_bytes"), F.lit(False))
    why = F.when(c("headline") | c("footer"), F.lit(None)).when(c("address"), F.when(limit, "limit")).when(phrase & c("prose"), "phrase").when(torn_word & c("prose") & ~c("figure"), "word").when(c("begun") & ~c("figure"), "sentence").when(limit, "limit")
    found = open_.select("record_type", "record_id", "source_id", why.alias("why")).unionByName(
        last.where("stopped or marked or torn").select("record_type", "record_id", "source_id", F.when(c("marked"), "mark").when(c("torn"), "torn").alias("why"))
    )
    return found.unionByName(last.where("stopped is null").select("record_type", "record_id", "source_id", F.lit(None).cast("string").alias("why"))).withColumn("cut", c("why").isNotNull())


def shares(found: DataFrame) -> DataFrame:
    """(record_type, source_id, n_values, n_cut, cut_share) of what truncated() gives, over values that aren't null."""
    return found.groupBy("record_type", "source_id").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))


def p3_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "feed_items")
    return truncated(texts_of(items, table(spark, sf_dir, "article_extractions")).where("text is not null"), items.select("title"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_truncated(spark, sf_dir).where("cut").select("record_type", "record_id")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p3_truncated(spark, sf_dir))
