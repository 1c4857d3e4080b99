"""URL keys as columns.

One rule throughout: scheme and host in lower case, default ports dropped, an empty path is "/", the query is divided
at "&", fragments are dropped.  What isn't an absolute address with a host gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One address: scheme, user, host (maybe an IPv6 one in brackets), port, path, query.
URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s\[\]]+)(?::([0-9]*))?((?:/[^?#]*)?)(?:\?([^#]*))?(?:#.*)?\s*$"
_PARTS = ["scheme", "user", "host", "port", "path", "query"]
#: Query keys that only track (fixed values): those dropped from links, and from article identities.
LINK_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
IDENTITY_TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
#: Endings of a path that all mean a site's or section's feed (fixed values).
FEED_ALIASES = r"/(?:rss|rss\.xml|feed|feed\.xml|atom\.xml|index\.xml|index\.rss|feeds)/?$"
#: Paths and queries of feeds, and paths that only look like them (fixed values).
FEED_PATH = r"/rss(/|$)|/rss\.[a-z0-9]+$|/feed(/|$)|/feeds(/|$)|/atom(/|$)|/atom\.[a-z0-9]+$|/index\.rss$|/index\.xml$"
FEED_QUERY = r"(^|&)(feed=(rss|atom|json)|format=(rss|atom|xml|json)|output=(rss|atom|xml|json)|service=rss(&|$))"
NO_FEED_PATH = r"/(feedback|contact|about|privacy|terms)(/|$)"


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often they are used later."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("__once")).select("*", "__once.*").drop("__once")


def with_url(df: DataFrame, column: str, prefix: str = "u_") -> DataFrame:
    """``df`` with the parts of an address; all are null where the text is none."""
    ok = F.col(column).rlike(URL)
    return once(df, **{prefix + n: F.when(ok, F.lower(p) if n in ("scheme", "host") else p) for i, n in enumerate(_PARTS) for p in [F.regexp_extract(column, URL, i + 1)]})


def valid_path(p: str = "u_") -> Column:
    """The path of a web address whose host has at least three characters; null for any other."""
    return F.when(F.col(p + "scheme").isin("http", "https") & (F.length(p + "host") >= 3), F.col(p + "path"))


def _port(p: str, any_default: bool = False) -> Column:
    port, scheme = F.col(p + "port"), F.col(p + "scheme")
    gone = (port == "") | (port.isin("80", "443") if any_default else ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")))
    return F.when(gone, "").otherwise(F.concat(F.lit(":"), port))


def _path(p: str) -> Column:
    path = F.regexp_replace(p + "path", r"/+$", "")
    return F.when(path == "", "/").otherwise(path)


def _query(pairs: Column) -> Column:
    kept = F.filter(pairs, lambda x: x != "")
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def clean_url(p: str = "u_") -> Column:
    """The address without fragment, tracking keys and trailing slashes."""
    pairs = F.filter(F.split(F.col(p + "query"), "&"), lambda x: ~F.substring_index(x, "=", 1).isin(LINK_TRACKING))
    return F.when(F.col(p + "scheme").isin("http", "https"), F.concat(F.col(p + "scheme"), F.lit("://"), F.col(p + "host"), _port(p), _path(p), _query(pairs)))


def canonical_identity(p: str = "u_") -> Column:
    """The article's identity: always https, no default port or final dot, tracking keys gone, parameters in order;
    null with credentials."""
    pairs = F.array_sort(F.filter(F.split(F.col(p + "query"), "&"), lambda x: ~F.lower(F.substring_index(x, "=", 1)).isin(IDENTITY_TRACKING)))
    host = F.regexp_replace(p + "host", r"\.$", "")
    return F.when(F.col(p + "scheme").isin("http", "https") & (F.col(p + "user") == ""), F.concat(F.lit("https://"), host, _port(p, True), _path(p), _query(pairs)))


def feed_key(p: str = "u_") -> Column:
    """One key for the ways to write a feed's address."""
    path = F.regexp_replace(F.lower(p + "path"), r"/$", "")
    path = F.regexp_replace(path, FEED_ALIASES, "/rss")
    return F.concat(F.col(p + "scheme"), F.lit("://"), F.col(p + "host"), _port(p), F.when(path == "", "/").otherwise(path), _query(F.array_sort(F.split(F.col(p + "query"), "&"))))


def source_identity(p: str = "u_", root_only: bool = False) -> Column:
    """Identity of a source: without www., fragment and final slash; its front page only if ``root_only``."""
    host = F.regexp_replace(p + "host", r"^www\.", "")
    base = F.concat(F.col(p + "scheme"), F.lit("://"), host, _port(p))
    rest = F.concat(F.regexp_replace(p + "path", r"/+$", ""), F.when(F.col(p + "query") == "", "").otherwise(F.concat(F.lit("?"), p + "query")))
    return F.when(F.col(p + "scheme").isin("http", "https"), base if root_only else F.concat(base, rest))


def domain_key(p: str = "u_") -> Column:
    return F.when(F.col(p + "scheme").isin("http", "https"), F.regexp_replace(p + "host", r"^www\.|\.$", ""))


def redacted(p: str = "u_", longest: int = 120) -> Column:
    """The address with the values of its query masked, cut with an ellipsis above ``longest`` characters."""
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(p + "query"), "&"), lambda x: x != ""), lambda x: F.concat(F.substring_index(x, "=", 1), F.lit("=[redacted]"))))
    path = F.when(F.col(p + "path") == "", "/").otherwise(F.col(p + "path"))
    out = F.concat(F.col(p + "scheme"), F.lit("://"), F.col(p + "host"), _port(p), path, _query(keys))
    return F.when(F.length(out) > longest, F.concat(F.left(out, F.lit(longest)), F.lit("…"))).otherwise(out)


def safe_url(p: str = "u_") -> Column:
    """Without credentials, query and fragment."""
    return F.concat(F.col(p + "scheme"), F.lit("://"), F.col(p + "host"), _port(p), F.when(F.col(p + "path") == "", "/").otherwise(F.col(p + "path")))


def is_feed_url(p: str = "u_") -> Column:
    path, query = F.lower(p + "path"), F.lower(p + "query")
    return ~path.rlike(NO_FEED_PATH) & (path.rlike(FEED_PATH) | query.rlike(FEED_QUERY) | F.concat(path, query).contains("jsonfeed") | F.concat(path, query).contains("feed+json"))


def url_date(column: Column) -> Column:
    """The date in an address: /Y/M/D, else a compact one (/Ymd), else /Y/M (its first day); null for none that is real."""
    def real(y: Column, m: Column, d: Column) -> Column:
        ok = y.between(2000, 2099) & m.between(1, 12) & (d >= 1) & (d <= F.dayofmonth(F.last_day(F.make_date(F.when(y.between(2000, 2099), y), F.when(m.between(1, 12), m), F.lit(1)))))
        return F.when(ok, F.make_date(F.when(ok, y), F.when(ok, m), F.when(ok, d)))

    num = lambda pattern, i: F.regexp_extract(column, pattern, i).try_cast("int")
    a, b, c = r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$|-)", r"/(\d{4})(\d{2})(\d{2})(?:/|$|-)", r"/(\d{4})/(\d{1,2})(?:/|$)"
    return F.coalesce(real(num(a, 1), num(a, 2), num(a, 3)), real(num(b, 1), num(b, 2), num(b, 3)), real(num(c, 1), num(c, 2), F.lit(1)))


def _blocked_v4(h: Column) -> Column:
    """Null where it is no IPv4 address."""
    a, b, c, d = (F.split_part(h, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4))
    inner = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    real = (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    return F.when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~F.coalesce(real, F.lit(False)) | F.coalesce(inner, F.lit(True)))


def _v6_groups(h: Column) -> Column:
    """The eight groups of an IPv6 address in full as hexadecimal digits without leading zeros, or null."""
    some = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    gap = h.contains("::")
    left, right = some(F.substring_index(h, "::", 1)), F.when(gap, some(F.substring_index(h, "::", -1))).otherwise(F.array().cast("array<string>"))
    fill = F.lit(8) - F.size(left) - F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.when(gap, F.greatest(fill, F.lit(0))).otherwise(0)), right)
    return F.when(h.rlike(r"^[0-9a-f:]+$") & ~h.rlike(":::|::.*::"), F.when(F.size(groups) == 8, F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))))


def is_blocked_ip(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address, brackets or none, is private, local, reserved or no address at all; an IPv4
    address inside an IPv6 one counts as itself."""
    h = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    tail = F.regexp_extract(h, r"^::(?:ffff:)?(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    g = _v6_groups(h)
    first = F.conv(F.get(g, F.lit(0)), 16, 10).cast("int")
    zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == "0")
    last4 = F.concat_ws(".", *[(F.conv(F.get(g, F.lit(i)), 16, 10).cast("int") / 256 if hi else F.conv(F.get(g, F.lit(i)), 16, 10).cast("int") % 256).cast("int") for i in (6, 7) for hi in (True, False)])
    mapped = zero(5) & F.get(g, F.lit(5)).isin("ffff", "0")
    own = first.bitwiseAND(0xFE00).isin(0xFC00) | first.bitwiseAND(0xFFC0).isin(0xFE80, 0xFEC0) | (first >= 0xFF00) | ((F.get(g, F.lit(0)) == "2001") & (F.get(g, F.lit(1)) == "db8"))
    v6 = F.when(mapped, _blocked_v4(last4)).otherwise(own)
    return F.coalesce(_blocked_v4(h), F.when(tail != "", _blocked_v4(tail)), v6, F.lit(True))


def is_public_host(host: Column) -> Column:
    """Whether a host may be asked: a public name, or an address outside the private ranges."""
    h = F.lower(F.regexp_replace(host, r"^www\.|\.$", ""))
    name = h.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$") & (F.length(h) <= 253) & ~h.rlike(r"(^|\.)(localhost|local|internal)$")
    return F.when(h.contains(":") | h.rlike(r"^[\d.]+$"), ~is_blocked_ip(h)).otherwise(name)


def same_family(a: Column, b: Column) -> Column:
    """Equal hosts, or one below the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))
