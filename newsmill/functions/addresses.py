"""Web addresses as columns: site, path and article number, whatever the spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that tell a campaign, not an article (fixed values; a trailing * stands for any ending).
CAMPAIGN_PARAMETERS = ["utm_*", "at_*", "pk_*", "mtm_*", "fbclid", "gclid", "dclid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "xtor", "cmpid", "ocid", "ito", "ref", "source", "src", "feed", "rss"]
#: Query parameters that hold an article's number (fixed values), asked before the path.
NUMBER_PARAMETERS = ["id", "p", "aid", "nid", "article", "articleid", "article_id", "story", "storyid", "post"]
#: Digits from which a number names an article.
LEAST_DIGITS = 7

SPACE = r"[\x00-\x20\x7f\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
_FOREST = r"(?i)^(?:https?:)?//(?:[^/?#@]*@)?"


def strip_space(c: Column) -> Column:
    """Without white space and control characters at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_address(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:https?:)?//[^/?#\s]+")


def site_of(address: Column) -> Column:
    """Host in lower case, without port and a leading www., m. or amp.; null where there is none."""
    host = F.lower(F.regexp_extract(strip_space(address), _FOREST + r"([^/?#:\s]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www|m|amp)\.|\.$", ""), F.lit(""))


def _decode(c: Column) -> Column:
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def with_article(df: DataFrame, text: str, prefix: str = "__a_") -> DataFrame:
    """``df`` with ``{prefix}site`` and ``{prefix}article``: what names the article on its site, ``n`` and its number,
    else ``p`` and its path; null for a front page and for what is no address.

    Fragments, campaign parameters, escapes, letter case, doubled and trailing slashes and AMP or mobile parts of
    the path don't matter.  The steps are columns of their own, so that each is computed once.
    """
    c = lambda n: F.col(prefix + n)
    params = "|".join(p.replace("*", "[^=&]*") for p in CAMPAIGN_PARAMETERS)
    digits = rf"(?<!\d)(\d{{{LEAST_DIGITS},}})(?!\d)"
    named = rf"(?i)(?:^|&)(?:{'|'.join(NUMBER_PARAMETERS)})=(\d{{{LEAST_DIGITS},}})(?!\d)"
    some = lambda x: F.nullif(x, F.lit(""))
    df = df.withColumn(prefix + "url", F.when(is_address(F.col(text)), F.col(text)))
    df = df.withColumns({prefix + "site": site_of(c("url")), prefix + "rest": F.regexp_replace(F.regexp_replace(c("url"), _FOREST + r"[^/?#]*", ""), r"#.*$", "")})
    df = df.withColumns({prefix + "path": F.regexp_extract(c("rest"), r"^([^?]*)", 1), prefix + "query": F.regexp_extract(c("rest"), r"\?(.*)$", 1)})
    df = df.withColumns({prefix + n: _decode(c(n)) for n in ("path", "query")})
    df = df.withColumns(
        {
            prefix + "path": F.regexp_replace(F.regexp_replace(F.lower(c("path")), r"/{2,}", "/"), r"^/(?:amp|m|mobile)(?=/)|(?:/amp|/index\.\w{3,5}|/default\.aspx?|/+)*$", ""),
            prefix + "query": F.regexp_replace(c("query"), rf"(?i)(?:^|&)(?:{params})=[^&]*", ""),
        }
    )
    number = F.coalesce(some(F.regexp_extract(c("query"), named, 1)), some(F.regexp_extract(c("path"), "^.*" + digits, 1)), some(F.regexp_extract(c("query"), digits, 1)))
    df = df.withColumn(prefix + "article", F.coalesce(F.concat(F.lit("n"), number), F.concat(F.lit("p"), some(c("path")))))
    return df.drop(*[prefix + n for n in ("url", "rest", "path", "query")])
