"""Links found on front pages: what a path is, which links look like articles, how likely each is one.

All are columns over the parts that ``with_link`` gives; an address that is none has null parts, and is rejected as
``invalid_url``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: Paths that aren't articles, and what they are; the first that matches counts (fixed values).
UTILITY = [
    ("^/?$", "homepage"),
    ("^/about", "about_page"),
    ("^/contact", "contact_page"),
    ("^/privacy", "privacy_page"),
    ("^/terms", "terms_page"),
    ("^/advertising", "advertising_page"),
    ("^/newsletter", "newsletter_page"),
    ("^/preferences", "preferences_page"),
    ("^/sitemap", "sitemap_page"),
    ("^/auth", "auth_page"),
    ("^/login", "login_page"),
    ("^/signup", "signup_page"),
    ("^/register", "register_page"),
    ("^/search", "search_page"),
    ("^/tag/", "tag_page"),
    ("^/topic", "topic_page"),
    ("^/players(?:/|$)", "player_directory"),
    ("^/teams(?:/|$)", "team_directory"),
    ("^/standings(?:/|$)", "standings_page"),
    ("^/schedule(?:/|$)", "schedule_page"),
    ("^/scores(?:/|$)", "scores_page"),
    ("^/stats(?:/|$)", "stats_page"),
    ("^/games(?:/|$)", "games_page"),
    ("^/tickets(?:/|$)", "tickets_page"),
    ("^/watch(?:/|$)", "watch_page"),
    ("^/category/?$", "category_index"),
    ("^/author/?$", "author_index"),
    ("^/wp-", "wordpress_admin"),
    ("^/feed/?$", "feed_url"),
    ("^/rss/?$", "rss_url"),
]
#: File names and parameters of addresses that lead on to another one (fixed values).
REDIRECT_NAMES = ["rd", "redirect", "redirector", "click", "away", "jump", "visit", "track", "fetch", "proxy", "gateway", "go", "out", "link", "url", "u"]
REDIRECT_PARAMETERS = ["url", "u", "dest", "destination", "target", "redirect", "goto", "next", "rurl", "href", "out", "link"]
REDIRECT_PATH = r"/[^/]*(?:" + "|".join(REDIRECT_NAMES) + r")\.[a-z0-9]+(?:$|/)"
REDIRECT_QUERY = "(?:^|&)(?:" + "|".join(REDIRECT_PARAMETERS) + ")="
#: Points of a link, and the least that are enough (fixed values).
POINTS = {"same_domain": 20, "not_utility": 15, "multi_segment_path": 10, "date_in_url": 10, "slug_pattern": 5, "category_match": 15, "has_title": 15, "has_date": 10}
ENOUGH = 30
DATED_PATH = r"/\d{4}/\d{2}/\d{2}/|/\d{8,}"
TITLE_LENGTH = 12


def with_link(df: DataFrame, column: str, p: str = "u_") -> DataFrame:
    """``df`` with the parts of an address, its site, its path without final slashes, and what the page there is."""
    df = U.once(U.with_url(df, column, p), **{p + "site": U.domain_key(p), p + "page": U._path(p), p + "low": F.lower(U._path(p))})
    return U.once(df, **{p + "utility": utility_reason(F.col(p + "low"))})


def utility_reason(path: Column) -> Column:
    """What the page at a path in lower case is, null if it may be an article."""
    which = F.coalesce(*[F.when(path.rlike(p), F.lit(reason)) for p, reason in UTILITY])
    return F.when(path.rlike("|".join(p for p, _ in UTILITY)), which)


def is_redirector(p: str = "u_") -> Column:
    """Whether an address leads on to one named in it."""
    hit = F.lower(p + "path").rlike(REDIRECT_PATH) | F.lower(p + "query").rlike(REDIRECT_QUERY)
    return F.coalesce(F.col(p + "scheme").isin("http", "https") & hit, F.lit(False))


def is_article_like(site: Column, p: str = "u_") -> Column:
    """On ``site``, with two segments, or one that is long, has two hyphens, or four digits."""
    path = F.regexp_replace(p + "path", "^/+|/+$", "")
    one = (F.length(path) >= 18) | path.rlike("-.*-") | path.rlike(r"\d{4}")
    return F.coalesce((F.col(p + "site") == site) & (path != "") & (path.contains("/") | one), F.lit(False))


def is_single_article(p: str = "u_") -> Column:
    """Strong signs of one article, whatever the depth of the path: a date, six digits, a long last segment or one with
    many hyphens."""
    path = F.regexp_replace(p + "path", "^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    dated = F.col(p + "path").rlike(r"/(?:19|20)\d{2}/[01]\d/[0-3]\d(?:/|$)")
    return (path != "") & (dated | path.rlike(r"\d{6,}") | (F.length(last) > 40) | (F.length(F.regexp_replace(last, "[^-]", "")) > 4))


def link_signals(site: Column, category: Column, title: Column, date: Column, p: str = "u_") -> Column:
    """The names in ``POINTS`` that hold of a link; ``category`` is a path without a final slash, null for none."""
    path = F.col(p + "page")
    last = F.element_at(F.split(path, "/"), -1)
    tests = {
        "same_domain": F.col(p + "site") == site,
        "not_utility": F.col(p + "utility").isNull(),
        "multi_segment_path": path.rlike("[^/]/+[^/]"),
        "date_in_url": path.rlike(DATED_PATH),
        "slug_pattern": (F.length(last) >= 12) & last.rlike("-.*-"),
        "category_match": (category != "/") & ((path == category) | F.startswith(path, F.concat(category, F.lit("/")))),
        "has_title": F.length(title) >= TITLE_LENGTH,
        "has_date": date != "",
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def link_score(signals: Column) -> Column:
    """The sum of a link's points; 0 for one of another site or of a utility page."""
    total = sum((F.when(F.array_contains(signals, n), points).otherwise(0) for n, points in POINTS.items()), F.lit(0))
    return F.when(F.array_contains(signals, "same_domain") & F.array_contains(signals, "not_utility"), total).otherwise(0)


def rejection(site: Column, score: Column, p: str = "u_") -> Column:
    """Why a link is rejected, null if it isn't."""
    return F.coalesce(
        F.when(F.col(p + "host").isNull() | site.isNull(), F.lit("invalid_url")),
        F.when(F.coalesce(F.col(p + "site") != site, F.lit(True)), F.lit("different_domain")),
        F.col(p + "utility"),
        F.when(score < ENOUGH, F.lit("low_score")),
    )
