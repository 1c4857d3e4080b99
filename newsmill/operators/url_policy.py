"""Whether an address looks like an article: weighted signals of its path, compiled from a table to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import once

#: Signals against an article (fixed values): reason, then label, weight and pattern of the path.
NEGATIVE = {
    "media_clip_path": [
        ("radio_clips", -80, r"/radio/clips?/"), ("podcast", -60, r"/podcasts?/"), ("audio", -60, r"/audio/"), ("listen", -60, r"/listen(/|$)"),
        ("player", -50, r"/player/"), ("clips", -70, r"(^|/)clips?(/|$)"), ("gallery", -40, r"/gallery/"), ("embed", -70, r"/embed/"), ("media_file", -100, r"\.(mp3|mp4|wav|m3u8|ogg|webm)$"),
    ],
    "video_only_path": [("video", -60, r"(^|/)video(/|$)"), ("video_prefix", -50, r"(^|/)video-")],
    "listing_or_topic_path": [
        ("topic", -80, r"(^|/)topics?(/|$)"), ("tag", -80, r"(^|/)tags?(/|$)"), ("category", -80, r"(^|/)categor(y|ies)(/|$)"), ("section", -60, r"(^|/)sections?(/|$)"),
        ("hub", -60, r"(^|/)hub(/|$)"), ("latest", -70, r"^/latest(/|$)"), ("most_read", -80, r"^/most[-_]?read(/|$)"), ("popular", -60, r"^/popular(/|$)"), ("trending", -70, r"^/trending(/|$)"),
        ("liveblog", -60, r"^/liveblog(/|$)"), ("live", -40, r"^/live(/|$)"), ("index_page", -80, r"^/index\."), ("discover", -70, r"^/discover(/|$)"), ("browse", -60, r"^/browse(/|$)"), ("explore", -60, r"^/explore(/|$)"),
    ],
    "feed_or_archive_path": [("archive", -80, r"^/archives?(/|$)"), ("sitemap", -100, r"^/sitemap"), ("feed", -100, r"^/feed(/|$)"), ("rss", -100, r"^/rss(/|$)"), ("atom", -100, r"^/atom(/|$)")],
    "account_or_private_path": [
        ("login", -100, r"^/login(/|$)"), ("signin", -100, r"^/sign[-_]?in(/|$)"), ("register", -100, r"^/register(/|$)"), ("account", -90, r"^/account(/|$)"), ("profile", -70, r"^/profile(/|$)"),
        ("user", -70, r"^/users?(/|$)"), ("my", -80, r"^/my(/|$)"), ("settings", -90, r"^/settings(/|$)"), ("dashboard", -80, r"^/dashboard(/|$)"), ("manage", -80, r"^/manage(/|$)"),
    ],
    "checkout_or_referral_path": [
        ("checkout", -100, r"^/checkout(/|$)"), ("referral", -100, r"^/referral(/|$)"), ("subscribe", -80, r"^/subscribe(/|$)"), ("subscription", -80, r"^/subscription(/|$)"),
        ("cart", -100, r"^/cart(/|$)"), ("shop", -80, r"^/shop(/|$)"), ("pricing", -80, r"^/pricing(/|$)"), ("store", -70, r"^/store(/|$)"),
    ],
    "search_or_query_page": [("search_path", -100, r"^/search(/|$)"), ("find", -80, r"^/find(/|$)")],
    "author_or_profile_path": [("author", -80, r"^/authors?(/|$)"), ("columnist", -70, r"^/columnists?(/|$)"), ("contributor", -70, r"^/contributors?(/|$)")],
    "utility_path": [
        ("newsletter", -90, r"^/newsletter"), ("preferences", -90, r"^/preferences(/|$)"), ("about", -90, r"^/about(/|$)"), ("contact", -90, r"^/contact(/|$)"), ("privacy", -100, r"^/privacy(/|$)"),
        ("terms", -100, r"^/terms(/|$)"), ("advertising", -90, r"^/advertising(/|$)"), ("careers", -90, r"^/careers?(/|$)"), ("help", -80, r"^/help(/|$)"), ("support", -80, r"^/support(/|$)"),
        ("advertise", -90, r"^/advertise(/|$)"), ("feedback", -90, r"^/feedback(/|$)"), ("auth", -100, r"^/auth(/|$)"), ("wordpress_admin", -100, r"^/wp-"),
    ],
}
#: Signals for an article (fixed values): label, weight, pattern of the path, and whether it counts against a strong
#: negative one.
POSITIVE = [
    ("date_path", 60, r"/\d{4}/\d{2}/\d{2}/|/\d{4}/\d{2}(/|$)", True), ("long_slug", 50, r"-[^/]*-[^/]*-[^/]*-[^/]*$", True), ("numeric_id", 40, r"/\d{5,}(/|$|[.?])", False),
    ("article_suffix", 40, r"\.(html?|cms)$", True), ("article_segment", 50, r"/(article|articles|news|story|stories|post|posts|blog)(\.[a-z]+)?/([^/]{8,}|[^/]*\d{4,}[^/]*|[^/]*-[^/]*)(/|$)", True), ("deep_path", 20, r"^(/[^/]+){3,}$", False),
]
#: Weights (fixed values): of a negative signal that dominates, of positive ones that override it, and of positive
#: ones that override any other.
STRONG_NEGATIVE, OVERRIDE_STRONG, OVERRIDE = -80, 100, 80
SEARCH, NO_SEARCH, FEED = r"(^|&)(q|query|search|s|keyword)=", r"(^|&)(id|article|post)=", r"(^|&)(feed|rss|atom)=(rss|atom|json|true|1)"


def signals() -> list[tuple[str, int, str, str | None]]:
    """(label, weight, pattern, reason) of all signals, the negative ones first."""
    neg = [(f"neg:{label}", w, p, reason) for reason, rows in NEGATIVE.items() for label, w, p in rows]
    return neg + [(f"pos:{label}", w, p, None) for label, w, p, _ in POSITIVE]


def judged(df: DataFrame, path: str, query: str) -> DataFrame:
    """``df`` with (accepted, reason) for the path and query of an http address; null paths are invalid.

    The first of these counts: a front page, a search, a feed, no negative signal, a dominating one against strong
    positive ones, strong positive ones, the sum.  Each pattern is tried once for a row.
    """
    c = F.col
    df = once(df, __p=F.lower(F.regexp_replace(path, r"/+$", "")), __q=F.lower(query))
    real = {f"pos:{label}" for label, _, _, strong in POSITIVE if strong}
    kind = "struct<w:int,reason:string,real:boolean>"
    hits = F.array_compact(F.array(*[F.when(c("__p").rlike(pat), F.struct(F.lit(w).alias("w"), F.lit(why).cast("string").alias("reason"), F.lit(label in real).alias("real")).cast(kind)) for label, w, pat, why in signals()]))
    df = once(df, __hits=hits)
    total = lambda keep: F.aggregate(F.filter("__hits", keep), F.lit(0), lambda a, x: a + x.w)
    df = once(df, __against=total(lambda x: x.w < 0), __for=total(lambda x: x.w > 0), __real=total(lambda x: x.real), __worst=F.array_min(F.filter("__hits", lambda x: x.w < 0).getField("w")))
    worst = F.coalesce("__worst", F.lit(0))
    kept = (worst == 0) | ((worst <= STRONG_NEGATIVE) & (c("__real") >= OVERRIDE_STRONG)) | ((worst > STRONG_NEGATIVE) & ((c("__for") >= OVERRIDE) | (c("__against") + c("__for") >= 0)))
    dominant = F.get(F.filter("__hits", lambda x: x.w == c("__worst")), F.lit(0)).reason
    searched = c("__q").rlike(SEARCH) & ~c("__q").rlike(NO_SEARCH)
    why = F.when(c(path).isNull(), "invalid_url").when(c("__p") == "", "utility_path").when(searched, "search_or_query_page").when(c("__q").rlike(FEED), "feed_or_archive_path").when(~kept, dominant)
    return once(df, reason=why).withColumn("accepted", c("reason").isNull()).drop("__p", "__q", "__hits", "__against", "__for", "__real", "__worst")


def with_matches(paths: Column) -> Column:
    """Labels of the signals that a path has, in the order of the table."""
    p = F.lower(F.regexp_replace(paths, r"/+$", ""))
    return F.array_compact(F.array(*[F.when(p.rlike(pat), label) for label, _, pat, _ in signals()]))
