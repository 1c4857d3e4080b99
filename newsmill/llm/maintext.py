"""Problem 5: the article's own lines among page furniture, by nearest-URL page differencing.

Pages of a host are put in order of their address, each is paired with its nearest neighbours that hold another
article, and their lines are aligned by longest common subsequence.  What a page shares with a neighbour is
furniture and deleted; a paragraph only if several neighbours have it, as articles may quote each other.

Neighbours are taken from a host's *line-up*: one page for each article and title, the first in order.  Places in it are
counted in two passes, so that they don't depend on partitions; slices of the line-up get the pages beyond their edges
as well, and slices with many pages (copies of one article) are divided, each part with the same neighbours.

Furniture that names people or other stories (bylines, teasers, bread crumbs) is never shared word for word.  It is
found by the differences too: with names and figures taken as slots, the form of a line is the same on many pages,
and where the shared lines are taken away, forms that stand before the first or behind the last paragraph of what is
left are furniture, forms that stand between paragraphs (subheads, lists, results) are the article's.  Lines with the
form of a headline of the corpus are teasers, what stands above them their heading, and rare forms in a run of lines
with a teaser or heading go with it, as do rare forms signed like a teaser and lines all in capitals.

Shuffled are addresses, and hashes of lines, a few bytes a line: by slice, by page, and by form, aggregated before the
shuffle.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.addresses import strip_space, with_article
from ..session import cut, small_join, table

#: Other articles on each side that a page is compared with.
NEIGHBOURS = 6
#: Places of the line-up in a slice.
SLICE = 128
#: Pages that a form must be on to be judged by its places, and the share of outer places that makes it furniture,
#: for lines with a final stop and for others.
LEAST_PAGES, OUTER_STOPPED, OUTER = 5, 0.95, 0.5
#: Share of a form's lines with a final stop that some neighbour has word for word, from which places decide.
AGAIN = 0.2
#: Neighbours that must share a paragraph.
PARAGRAPH_SHARES = 3
#: Characters from which a line with a final stop is a paragraph, and where a script has no spaces.
PARAGRAPH, PARAGRAPH_DENSE = 110, 40

_NAME = regex.compile(r"\p{Lu}\p{Ll}[\p{L}\p{M}’'\-]*+(?:[ \-]+\p{Lu}\p{Ll}[\p{L}\p{M}’'\-]*+)*")
_DIGITS = regex.compile(r"\d+")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_STOP = regex.compile(r"[.!?。！？…][\"”“»’)\]」』]*$")
_NUMBER, _COUNT = regex.compile(r"^(?:0[.)]|[•*»›>-])\s*"), regex.compile(r"(?:\s*\(0\))+$")
_TAIL, _HEAD = regex.compile(r"(?:\s+[–—|·-] N|, N|\s*\(N\))+$"), regex.compile(r"^N: ")
_INNER = regex.compile(r"\p{Ll}[.!?][\"”“»’)]* [\"“„«]?\p{Lu}")
_SECTIONS = regex.compile(r"^(?:[^›»]{1,24} [›»] )+")
_CRUMBS = regex.compile(r"\s[›»|/·]\s")
_WORD, _PLAIN = regex.compile(r"\p{Ll}{2,}"), regex.compile(r"(?<!\p{L})\p{Ll}{2,}")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}]+")


def tidy(line: str) -> str:
    return " ".join(_INVISIBLE.sub(" ", line).split()) if not line.isascii() or "\t" in line or "\r" in line else " ".join(line.split())


def form(line: str) -> str:
    """A tidy line with figures and names as slots, in lower case."""
    s = _NAME.sub("\x00", _DIGITS.sub("0", line)).lower()
    return s.replace("\x00", "N")


def cores(shape: str) -> list[str]:
    """What may be a headline in a line's form: without sections, number, count and author."""
    a = _COUNT.sub("", _NUMBER.sub("", _SECTIONS.sub("", shape)))
    b = _TAIL.sub("", a)
    return list({a: 0, b: 0, _HEAD.sub("", a): 0, _HEAD.sub("", b): 0})


def is_headline(shape: str) -> bool:
    """Enough of its own words to be told from other forms."""
    return len(_WORD.findall(shape)) >= 2 or len(_DENSE.findall(shape)) >= 5


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


_LINE = pa.struct([("no", pa.int32()), ("line", pa.int64()), ("form", pa.int64()), ("kind", pa.int8()), ("cores", pa.list_(pa.int64()))])
_DDL = "array<struct<no:int,line:bigint,form:bigint,kind:tinyint,cores:array<bigint>>>"


def _features(text: str | None) -> list[dict]:
    out = []
    lines = [(no, line) for no, raw in enumerate((text or "").split("\n"), 1) if (line := tidy(raw))]
    for no, line in lines:
        shape = form(line)
        stopped, inner = bool(_STOP.search(line)), bool(_INNER.search(line))
        found = [] if stopped or inner else [c for c in cores(shape) if is_headline(c)]
        signed = len(found) > 1 or bool(found and found[0] != shape)
        if signed and no == lines[-1][0] and not _COUNT.search(shape) and shape.endswith(", N"):
            signed = False  # rather a paragraph cut behind a name
        long = inner or (len(line) >= (PARAGRAPH_DENSE if len(_DENSE.findall(line)) * 3 > len(line) else PARAGRAPH) and not signed)
        plain = not stopped and len(_PLAIN.findall(line)) >= 6 and not _CRUMBS.search(line)
        kind = stopped + 2 * long + 4 * signed + 8 * plain + 16 * (line.isupper() and " " in line)
        out.append({"no": no, "line": _hash(_DIGITS.sub("0", line).lower()), "form": _hash(shape), "kind": kind, "cores": [_hash(c) for c in found]})
    return out


def lcs(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of indexes of a longest common subsequence: equal ends are taken off, then the longest chain of matches is
    grown one line of ``a`` at a time (one entry a match, not a table of lines by lines)."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    chain, link = [], links[-1] if links else None
    while link:
        chain.append(link[:2])
        link = link[2]
    ends_ = [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    return [(i, i) for i in range(head)] + chain[::-1] + ends_


class LineUp:
    """Part of the line-up: (site, article, title, lines) by place."""

    def __init__(self, at: dict[int, tuple]):
        self.at, self.memo = at, {}

    def near(self, place: int, inside: bool, site: str, article: str | None, title: str | None) -> Iterator[int]:
        """Places of the nearest NEIGHBOURS pages on each side that hold another article under another title; at most one
        page of the line-up has the same article and one the same title."""
        before = range(place - (1 if inside else 0), place - NEIGHBOURS - 3, -1)
        for side in (before, range(place + 1, place + NEIGHBOURS + 3)):
            n = 0
            for p in side:
                other = self.at.get(p)
                if other is None or other[0] != site:
                    break
                if (article is not None and other[1] == article) or (title is not None and other[2] == title):
                    continue
                yield p
                n += 1
                if n == NEIGHBOURS:
                    break

    def times(self, place: int, inside: bool, site: str, article: str | None, title: str | None, lines: tuple[int, ...]) -> Counter:
        """How many neighbours share each line, by index.  A pair of pages of the line-up is aligned once, the earlier
        page first."""
        out: Counter = Counter()
        own = set(lines)
        for p in self.near(place, inside, site, article, title):
            other = self.at[p][3]
            if own.isdisjoint(other):
                continue
            if inside and lines == self.at[place][3]:
                key = (min(place, p), max(place, p))
                if key not in self.memo:
                    self.memo[key] = lcs(self.at[key[0]][3], self.at[key[1]][3])
                out.update(i if place < p else j for i, j in self.memo[key])
            else:
                out.update(i for i, _ in (lcs(lines, other) if place < p else [(j, i) for i, j in lcs(other, lines)]))
        return out


def line_up(feats: DataFrame, key: str) -> DataFrame:
    """(key, place, inside) of all pages with a site: ``place`` is that of the page of the line-up at or before it,
    ``inside`` tells whether it is that page."""
    c = F.col
    pages = feats.where("site.s is not null and size(lines) > 0").select(c(key).alias("k"), c("site.s").alias("s"), c("site.p").alias("p"), "article", "title")
    # Pages without an article number or path are articles of their own, pages without a title have a title of their own.
    pages = pages.withColumn("a", F.coalesce(F.concat(F.lit("a"), "article"), F.concat(F.lit("k"), c("k").cast("string"))))
    first = pages.groupBy("s", "a").agg(F.min(F.struct("p", "k", "title")).alias("m")).select("s", "a", "m.*")
    first = first.withColumn("t", F.coalesce(c("title").cast("string"), F.concat(F.lit("k"), c("k").cast("string"))))
    heads = first.groupBy("s", "t").agg(F.min(F.struct("p", "k")).alias("m")).select("s", c("m.p").alias("p"), c("m.k").alias("k"), F.lit(True).alias("inside"))
    ordered = first.select("s", "p", "k", "a").join(heads, ["s", "p", "k"], "left").select("s", "p", "k", "a", F.coalesce("inside", F.lit(False)).alias("inside"))
    ordered = ordered.repartitionByRange("s", "p", "k").sortWithinPartitions("s", "p", "k").withColumn("row", F.monotonically_increasing_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            so_far = np.cumsum(b.column(3).to_numpy(zero_copy_only=False)) + n
            n = int(so_far[-1]) if len(so_far) else n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(so_far, pa.int64())], ["s", "k", "a", "inside", "row", "here"])

    kind = feats.schema[key].dataType.simpleString()
    counted = cut(ordered.select("s", "k", "a", "inside", "row").mapInArrow(lambda bs: count(b.select([0, 1, 2, 3, 4]) for b in bs), f"s string, k {kind}, a string, inside boolean, row bigint, here bigint"))
    part = F.shiftright("row", 33)
    sizes = counted.groupBy(part.alias("part")).agg(F.max("here").alias("n")).collect()  # one row a partition
    before, total = [], 0
    for part_no, n in sorted((r[0], r[1]) for r in sizes):
        before.append((part_no, total))
        total += n
    before = feats.sparkSession.createDataFrame(before, "part bigint, before bigint")
    placed = counted.withColumn("part", part).join(F.broadcast(before), "part").select("s", "a", "k", "inside", (c("here") + c("before")).alias("place"))
    # Other pages of an article take its place.
    copies = pages.select("s", "a", c("k").alias("page")).join(placed, ["s", "a"])
    return copies.select(c("page").alias(key), "place", (c("inside") & (c("page") == c("k"))).alias("inside"))


def classify(pages: DataFrame, key: str, url: str, title: str, text: str) -> DataFrame:
    """(key, line_no, furniture boolean) for the lines that aren't blank of all pages that have article text.

    Null and empty texts and texts without a paragraph of their own give no row.  Pages without an address are judged
    by the forms of their lines only.  Keys should be unique: a page that comes twice is judged twice.  Extra columns
    are ignored.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = pa.array([_features(t) for t in b.column(4).to_pylist()], pa.list_(_LINE))
            heads = [form(tidy(t or "")) for t in b.column(3).to_pylist()]
            heads = pa.array([_hash(h) if is_headline(h) else None for h in heads], pa.int64())
            same = [tidy(t or "").lower() for t in b.column(3).to_pylist()]
            same = pa.array([_hash(t) if t else None for t in same], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), heads, same, lines], [key, "site", "article", "head", "title", "lines"])

    def align(of_slice: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        listed = LineUp({r.l_place: (r.l_site, r.l_article, r.l_title, tuple(r.hashes)) for r in of_slice.itertuples(index=False)})
        rows: list[tuple] = []
        known: dict = {}
        for r in mine.itertuples(index=False):
            lines = r.lines
            hashes = tuple(x["line"] for x in lines)
            place = None if r.place is None or r.place != r.place else int(r.place)
            at = (place, bool(r.inside), r.site, r.article, r.title, hashes)
            if at not in known:
                known[at] = Counter() if place is None else listed.times(*at)
            times = known[at]
            shared = {i for i, n in times.items() if n >= (PARAGRAPH_SHARES if lines[i]["kind"] & 3 == 3 else 1)}
            prose = [i for i, x in enumerate(lines) if (x["kind"] & 3 == 3 or x["kind"] & 10 == 10) and i not in shared]
            # The article lies between its first and last paragraph that no neighbour has.
            sure = [i for i in prose if i not in times] or prose
            first, last = (sure[0], sure[-1]) if prose else (-1, -1)
            for i, x in enumerate(lines):
                rows.append((r.page, x["no"], i in shared, i in times, x["form"], x["kind"], bool(prose) and not first <= i <= last, bool(prose)))
        return pd.DataFrame(rows, columns=[key, "line_no", "shared", "met", "form", "kind", "outer", "has_text"])

    id_type = pages.schema[key].dataType.simpleString()
    p = pages.select(F.col(key), strip_space(F.col(url)).alias("url"), F.col(title).alias("title"), F.col(text).alias("text"))
    p = with_article(p, "url").select(key, "__a_site", F.concat_ws(" ", "__a_article", F.regexp_replace(F.lower("url"), r"^https?://[^/]*|#.*$", "")).alias("at"), "__a_article", "title", "text")
    p = p.select(key, F.struct(F.col("__a_site").alias("s"), F.col("at").alias("p")).alias("site"), F.col("__a_article").alias("article"), "title", "text")
    feats = cut(p.mapInArrow(features, f"`{key}` {id_type}, site struct<s:string,p:string>, article string, head bigint, title bigint, lines {_DDL}"))
    heads = feats.select(F.col("head").alias("core")).where("core is not null").distinct()
    c = F.col
    places = cut(line_up(feats, key))
    slim = F.transform("lines", lambda x: F.struct(x.no.alias("no"), x.line.alias("line"), x.form.alias("form"), x.kind.alias("kind")))
    rows = feats.where(F.size("lines") > 0).join(places, key, "left").select(c(key).alias("page"), c("site.s").alias("site"), "article", c("title").cast("string").alias("title"), slim.alias("lines"), "place", "inside")
    # Slices of the line-up, divided where they have many pages; pages without a site have none to be compared with.
    rows = rows.withColumn("slice", F.coalesce(F.floor(c("place") / SLICE), -1 - F.pmod(F.xxhash64("page"), F.lit(64))))
    rows = cut(rows)
    parts = cut(rows.groupBy("slice").agg((F.floor(F.count("*") / (4 * SLICE)) + 1).alias("parts")))
    # A row for each slice (of SLICE articles): broadcast while it is small, else joined like anything else.
    pages_ = small_join(rows, parts, ["slice"], "page", "inner").withColumn("part", F.pmod(F.xxhash64("page"), c("parts"))).drop("parts")
    listed = rows.where("inside").select(
        c("place").alias("l_place"), c("site").alias("l_site"), c("article").alias("l_article"), c("title").alias("l_title"), F.transform("lines", lambda x: x.line).alias("hashes")
    )
    near = F.array_distinct(F.array(*[F.floor((c("l_place") + d) / SLICE) for d in (-NEIGHBOURS - 2, 0, NEIGHBOURS + 2)]))
    listed = listed.withColumn("at", F.explode(near))
    listed = small_join(listed, parts.select(c("slice").alias("at"), "parts"), ["at"], "l_place", "inner").withColumn("of", F.explode(F.sequence(F.lit(0), c("parts") - 1))).drop("parts")
    ddl = f"`{key}` {id_type}, line_no int, shared boolean, met boolean, form bigint, kind tinyint, outer boolean, has_text boolean"
    lines = cut(listed.groupBy("at", "of").cogroup(pages_.groupBy("slice", "part")).applyInPandas(align, ddl))
    # Teasers: a core of the line is the form of a headline.
    by_form = feats.select(F.explode("lines").alias("x")).where(F.size("x.cores") > 0).select("x.form", F.explode("x.cores").alias("core")).distinct()
    teasers = by_form.join(heads, "core", "left_semi").select("form").distinct().withColumn("teaser", F.lit(True))
    told = small_join(lines, teasers, ["form"], key)
    page = Window.partitionBy(key).orderBy("line_no")
    told = told.where("has_text").withColumn("above_teaser", F.coalesce(F.lead("teaser").over(page), F.lit(False)))
    told = cut(told.withColumn("run", F.sum(F.when(F.col("kind") % 4 >= 1, 1).otherwise(0)).over(page.rowsBetween(Window.unboundedPreceding, 0))))
    share = lambda c: F.avg(F.col(c).cast("double"))
    stats = told.groupBy("form").agg(F.count("*").alias("n"), share("outer").alias("outside"), share("shared").alias("common"), share("met").alias("again"), share("above_teaser").alias("heading"))
    stats = cut(stats.where(F.col("n") >= LEAST_PAGES))
    told = small_join(told, stats, ["form"], key)
    known, prose, signed, teaser = c("n").isNotNull(), c("kind") % 4 >= 1, c("kind").bitwiseAND(4) != 0, F.coalesce(c("teaser"), F.lit(False))
    by_place = F.when(prose, (c("outside") >= OUTER_STOPPED) | (((c("common") >= 0.5) | (c("again") >= AGAIN)) & (c("outside") >= OUTER))).otherwise(teaser | (c("outside") >= OUTER) | (c("common") >= 0.5) | (c("heading") >= 0.5))
    told = told.withColumn("in_block", F.max(~prose & (teaser | F.coalesce(c("heading") >= 0.5, F.lit(False)))).over(Window.partitionBy(key, "run")))
    capitals = c("kind").bitwiseAND(16) != 0
    furniture = F.when(known, by_place).otherwise(capitals | ~prose & (c("shared") | teaser | signed | ((c("outer") | c("in_block")) & (c("kind").bitwiseAND(8) == 0))))
    return told.select(key, "line_no", "kind", furniture.alias("furniture"))


def furniture_lines(pages: DataFrame, key: str, url: str, title: str, text: str) -> DataFrame:
    """(key, line_no) of the lines that aren't the article's own, of pages with at least one own line that ends as a
    sentence."""
    told = classify(pages, key, url, title, text)
    w = told.groupBy(key).agg(F.max(~F.col("furniture") & ((F.col("kind") % 2 == 1) | (F.col("kind").bitwiseAND(10) == 10))).alias("own"))
    return told.where("furniture").join(w.where("own"), key, "left_semi").select(key, "line_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture_lines(table(spark, sf_dir, "article_extractions"), "extraction_id", "resolved_url", "title", "body_text")
