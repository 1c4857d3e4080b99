"""Which container of a page holds its article: scores, ranks and the choice, all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

c = F.col


def _n() -> Column:
    return F.size("paragraphs")


def _chars() -> Column:
    return F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p))


def _steps(value: Column, *steps: tuple[float, int], otherwise: int = 0) -> Column:
    """The points of the first step that the value reaches."""
    out = F.lit(otherwise)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def score(excerpt: Column) -> Column:
    """The score of a container by its measures, never below 0 (points are fixed values)."""
    mean, yield_ = _chars() / _n(), F.when(c("raw_length") > 0, _chars() / c("raw_length")).otherwise(1.0)
    alike = F.coalesce(T.word_overlap(F.array_join("paragraphs", " "), excerpt), F.lit(0.0))
    first = F.length(F.get("paragraphs", F.lit(0)))
    parts = [
        _steps(_n(), (8, 35), (5, 28), (4, 22), (3, 15), (2, 8), otherwise=2),
        _steps(_chars(), (3000, 30), (1500, 24), (1200, 18), (800, 12), (400, 5)),
        F.when(mean > 800, 5).when(mean >= 80, 10).otherwise(0),
        F.when(c("selector").isin("article", "main article", "[itemprop=articleBody]", "[property=articleBody]", ".article-body", ".article__body", ".article-content", ".article__content"), 15).otherwise(0),
        F.when(c("lead"), -20).otherwise(0),
        F.when(c("caption"), -15).otherwise(0),
        F.when(c("bullets"), -15).otherwise(0),
        F.when((alike > 0.8) & (_chars() < 2000), -20).when((alike > 0.6) & (_chars() < 1500), -10).otherwise(0),
        F.when(c("link_share") > 0.5, -20).when(c("link_share") > 0.3, -10).otherwise(0),
        F.when(c("furniture") > 0.3, -15).when(c("furniture") > 0.1, -5).otherwise(0),
        F.when(c("repeated") > 2, -10).when(c("repeated") > 0, -3).otherwise(0),
        F.when(c("headings") > 0.5 * _n(), -8).otherwise(0),
        F.when(c("ends") >= 3, -15).when(c("ends") >= 1, -8).otherwise(0),
        F.when((c("raw_length") > 1000) & (yield_ < 0.3), -25).when((c("raw_length") > 800) & (yield_ < 0.4), -15).otherwise(0),
        F.when((_n() >= 2) & (first < 0.3 * mean) & (first < 200) & (_chars() < 2000), -12).otherwise(0),
    ]
    return F.greatest(F.lit(0), sum(parts[1:], parts[0]))


def ranked(containers: DataFrame, key: str) -> DataFrame:
    """``containers`` (with ``excerpt``) and their score, rank, length and the reason why one can't be the body (null if
    it can): not_usable, lead_dominated or truncated."""
    few = (_n() <= 2) & F.forall("paragraphs", lambda p: F.length(p) < 150) & (c("raw_length") > 3 * _chars()) & (c("raw_length") > 600)
    there = F.when(c("clean_length") > 0, c("clean_length")).otherwise(c("raw_length"))
    share = _chars() / there
    cut = (there >= 800) & (((share < 0.3) & (_n() < 4)) | ((share < 0.15) & (there > 2000)))
    text = F.array_join("paragraphs", "\n\n")
    n, chars = _n(), F.length(text)
    usable = ((n >= 3) & (chars >= 500)) | ((n >= 2) & (chars >= 800)) | ((chars >= 1200) & (c("link_share") < 0.2) & (c("furniture") < 0.2))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    out = containers.withColumns({"score": score(c("excerpt")), "n_paragraphs": _n(), "text_length": _chars(), "text": text})
    return out.withColumns({"rank": F.row_number().over(w), "refused": F.when(~usable, "not_usable").when(few, "lead_dominated").when(cut, "truncated")})


def chosen(ranked_: DataFrame, key: str, tries: int = 3) -> DataFrame:
    """(key, body, selector, score, n_paragraphs, tried): the best of the first ``tries`` containers that can be the body,
    its text capped at a paragraph; pages whose containers are all refused have a null body and the reasons in ``tried``."""
    first = ranked_.where(c("rank") <= tries)
    good = F.min(F.when(c("refused").isNull(), F.struct("rank", "text", "selector", "score", "n_paragraphs"))).alias("b")
    tried = F.array_sort(F.collect_list(F.when(c("refused").isNotNull(), F.struct("rank", "refused")))).alias("t")
    out = first.groupBy(key).agg(good, tried)
    before = F.filter("t", lambda x: c("b").isNull() | (x["rank"] < c("b.rank")))
    return out.select(key, T.cap_body(c("b.text")).alias("body"), c("b.selector").alias("selector"), c("b.score").alias("score"), c("b.n_paragraphs").alias("n_paragraphs"), F.transform(before, lambda x: x["refused"]).alias("tried"))


def prefers(current: Column, current_n: Column, other: Column, other_n: Column) -> Column:
    """Whether another body (of a reader-mode pass or of structured data) takes the place of the current one: where there
    is none, where it is short and the other isn't, or where the other is clearly more complete."""
    a, b = F.coalesce(F.length(current), F.lit(0)), F.coalesce(F.length(other), F.lit(0))
    more = ((a < 500) & (b >= 800)) | ((other_n >= current_n + 3) & (b >= a * 1.15)) | ((b >= a * 1.5) & (other_n >= current_n))
    return (b > 0) & ((a == 0) | F.coalesce(more, F.lit(False)))


def n_paragraphs(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(F.filter(F.split(text, r"\n{2,}"), lambda p: F.trim(p) != ""))).otherwise(0)


def confidence(body: Column, selector: Column, title: Column, excerpt: Column, author: Column, published: Column, paywall: Column) -> Column:
    """How sure an extraction is, 0 to 1 (points are fixed values)."""
    n = F.coalesce(F.length(body), F.lit(0))
    has = lambda x, points: F.when(F.coalesce(F.trim(x), F.lit("")) != "", points).otherwise(0.0)
    out = F.when(n >= 2000, 0.4).when(n >= 1000, 0.3).when(n >= 500, 0.2).otherwise(0.0) + F.when(n >= 3000, 0.1).when(n >= 1500, 0.05).otherwise(0.0)
    out = out + F.when(selector.isin("article", "main article", "[itemprop=articleBody]"), 0.15).when(selector.isNotNull(), 0.05).otherwise(0.0)
    out = out + has(title, 0.1) + has(excerpt, 0.05) + has(author, 0.05) + has(published, 0.05) - F.when(F.coalesce(paywall, F.lit(False)), 0.15).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 6)
