"""Text transforms as columns. Lengths are code points."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lines that are page furniture by how they begin (fixed values).
BOILERPLATE_LINES = [
    r"^(share|tweet|pin|email|print|subscribe|sign up|follow us)", r"^(related articles?|more (from|stories|news)|you may also like)",
    r"^(advertisement|sponsored|promoted)", r"^(©|copyright|all rights reserved)", r"^(click here|read more|continue reading|load more)",
    r"^(loading|please wait)", r"^(cookie|privacy policy|terms of (use|service))",
]
#: Named entities and what they become (fixed values).
ENTITIES = {"amp": "&", "apos": "'", "quot": '"', "lt": "<", "gt": ">", "nbsp": " ", "ndash": "-", "mdash": "-", "hellip": "...", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"'}
#: Most characters of a stored body.
BODY_CAP = 50_000


def strip_html(c: Column) -> Column:
    """Without CDATA marks, scripts, styles and tags; white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")
    c = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def collapse_whitespace(c: Column) -> Column:
    """Blanks collapsed, lines trimmed, at most one empty line between paragraphs."""
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[\t ]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), "\n"), r"^[ \n]+|[ \n]+$", "")


def without_boilerplate_lines(c: Column) -> Column:
    bad = "|".join(f"(?:{p})" for p in BOILERPLATE_LINES)
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.lower(F.trim(x)).rlike(bad)), "\n")


def is_meaningful(p: Column) -> Column:
    """A paragraph that is neither navigation nor very short, by length, share of letters, and words where the script
    has spaces."""
    t = F.trim(p)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    dense = t.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]")
    return (F.length(t) >= 20) & (letters >= 0.4 * F.length(t)) & F.when(dense, letters >= 12).otherwise(F.size(F.split(t, r"[ \t\n\r]+")) >= 4)


def is_usable_body(c: Column) -> Column:
    n, chars = F.size(F.filter(F.split(c, r"\n{2,}"), lambda p: F.trim(p) != "")), F.length(c)
    return ((n >= 3) & (chars >= 500)) | ((n >= 2) & (chars >= 800)) | ((n >= 1) & (chars >= 1200))


def sentence_ends(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[.!?]+(?=[ \t\n\r]|$)|[。！？؟…]+"))


def words(c: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.trim(c)), r"[ \t\n\r]+"))


def word_overlap(a: Column, b: Column, shortest: int = 3) -> Column:
    """Shared words over the smaller set's size; words below ``shortest`` characters don't count; 0 for no words."""
    x, y = (F.filter(words(c), lambda w: F.length(w) >= shortest) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.round(F.size(F.array_intersect(x, y)) / least, 6)).otherwise(F.lit(0.0))


def body_is_excerpt(body: Column, excerpt: Column) -> Column:
    """Whether a body is no more than its excerpt: equal, one the beginning of the other at about its length, or the
    same words at less than twice its length."""
    b, e = F.lower(F.trim(body)), F.lower(F.trim(excerpt))
    nb, ne = F.length(b), F.length(e)
    long = (nb > 20) & (ne > 20)
    x, y = words(body), words(excerpt)
    same = (nb <= 2 * ne) & (F.size(x) >= 5) & (F.size(y) >= 5) & (F.size(F.array_intersect(x, y)) > 0.85 * F.least(F.size(x), F.size(y)))
    full = (nb > 0) & (ne > 0)
    return F.coalesce(full & ((b == e) | (long & F.startswith(b, e) & (nb < ne * 1.5)) | (long & F.startswith(e, b) & (nb > ne * 0.7)) | same), F.lit(False))


def cap_body(c: Column, cap: int = BODY_CAP) -> Column:
    """At most ``cap`` characters, cut at the last paragraph's end where that keeps more than half."""
    head = F.left(c, F.lit(cap))
    tail = F.locate("\n\n", F.reverse(head))
    at = cap - tail - 1
    return F.when(F.length(c) <= cap, c).when((tail > 0) & (at > cap * 0.5), F.left(head, at)).otherwise(head)


def preview(c: Column, longest: int = 240) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[\x00-\x1f\x7f]", " ")
    return F.left(F.trim(F.regexp_replace(c, r" +", " ")), F.lit(longest))


def content_hash(*parts: Column) -> Column:
    kept = F.filter(F.array(*[F.coalesce(F.trim(p), F.lit("")) for p in parts]), lambda x: x != "")
    return F.sha2(F.array_join(kept, "|"), 256)


def class_tokens(c: Column) -> Column:
    """Tokens of a class or id value: divided at marks, case changes and before final figures."""
    c = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9]+)", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != ""))


#: Characters whose UTF-8 bytes, read as Windows-1252, are put right by replacement (fixed values); what is shown for
#: them is that rule's result, but for the two behind.
REPLACED = "‘’“„–—…€£ÉéáíóöúüÁÍÓÖÚÜ\u00a0"
REPLACED_ELSE = {"â€\x9d": "”", "â€": "”"}
#: What tells of a wrong decoding; each that a text has counts one (fixed values).
SUSPICIOUS = ["â€", "â‚¬", "Ã", "Â", "Ä", "\x18", "\x19", "\x1d", "\x1e", "\ufffd"]


def replacements() -> dict[str, str]:
    """Shown characters to those meant, longest first, so that no beginning of another is taken for it."""
    shown = {"".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in c.encode()): c for c in REPLACED}
    return dict(sorted({**shown, **REPLACED_ELSE}.items(), key=lambda x: -len(x[0])))


def suspicion(c: Column) -> Column:
    """How many of SUSPICIOUS a text has, and one more if a UTF-8 lead is followed by what stands for its next byte."""
    likely = F.when(c.rlike(r"[ÃÂÅÄ][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€"), 1).otherwise(0)
    return sum((F.when(c.contains(s), 1).otherwise(0) for s in SUSPICIOUS), likely)


def normalize_text_detailed(c: Column) -> Column:
    """struct(value, flags, suspicion_score, changed): a feed's text as a reader should see it, and what was done to it.
    Null stays null; flags come each once, in the order of the steps."""
    t0 = F.trim(c)
    t1 = F.regexp_replace(t0, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")
    t2 = F.when(t1.contains("&"), unescape(t1)).otherwise(t1)
    t3 = t2
    for shown, meant in replacements().items():
        t3 = F.replace(t3, F.lit(shown), F.lit(meant))
    t3 = F.when(t2.rlike("[ÃÂâ]"), t3).otherwise(t2)
    t4 = F.when(t3.rlike("[ÃÂÅâ]"), repair_mojibake(t3)).otherwise(t3)
    steps = F.struct(t0.alias("t0"), t1.alias("t1"), t2.alias("t2"), t4.alias("t4"))
    flag = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    # An array of one struct keeps the steps from being computed again for each use.
    one = F.transform(
        F.array(steps),
        lambda s: F.struct(
            s.t4.alias("value"),
            F.array_distinct(F.concat(
                flag(s.t1 != s.t0, "cdata_stripped"), flag(s.t2 != s.t1, "entity_decoded"), flag(s.t4 != s.t2, "mojibake_repaired"), flag((suspicion(s.t4) > 0) | (suspicion(s.t2) > 0), "suspected_mojibake"),
            )).alias("flags"),
            suspicion(s.t4).alias("suspicion_score"),
            (s.t4 != s.t0).alias("changed"),
        ),
    )
    return F.when(c.isNotNull(), F.get(one, F.lit(0)))


_MARKERS = ("Ã", "Â", "Å", "â")


def repair_mojibake_text(s: str | None) -> str | None:
    """UTF-8 that was read once or twice as Windows-1252, read back; anything else unchanged."""
    for _ in range(2):
        if not s or not any(m in s for m in _MARKERS):
            break
        try:
            b = b"".join(bytes([ord(ch)]) if ord(ch) <= 0xFF else ch.encode("cp1252") for ch in s)
            new = unicodedata.normalize("NFC", b.decode("utf-8"))
        except UnicodeError:
            break
        if not new or new == s:
            break
        s = new
    return s


def _repair(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(repair_mojibake_text, na_action="ignore")


def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


def repair_mojibake(c: Column | str) -> Column:
    return F.pandas_udf(_repair, StringType())(c)


def unescape(c: Column | str) -> Column:
    return F.pandas_udf(_unescape, StringType())(c)


def decode_named_entities(c: Column) -> Column:
    """Named entities of ENTITIES; ``&amp;`` last, so that nothing is decoded twice."""
    for name, to in ENTITIES.items():
        if name != "amp":
            c = F.regexp_replace(c, f"(?i)&{name};", to.replace("$", r"\$"))
    return F.regexp_replace(c, "(?i)&amp;", "&")


def normalize_text(c: Column) -> Column:
    """Trimmed, CDATA marks gone, entities decoded, wrong decodings repaired; the Python steps see only texts that
    need them."""
    t = F.regexp_replace(F.trim(c), r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")
    t = F.when(t.contains("&"), unescape(t)).otherwise(t)
    return F.when(t.rlike("[ÃÂÅâ]"), repair_mojibake(t)).otherwise(t)
