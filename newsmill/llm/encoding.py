"""Problem 6: text decoded with the wrong character encoding.

A wrong decoding is a substitution cipher.  What each odd character of a source stands for is learned by
expectation-maximization against the bigrams of the languages of the whole corpus:

1. *Bytes read back.*  Multi-byte encodings (UTF-8, once or several times over, and the East Asian ones) leave several
   characters for one; such words are read back by the page that shows their bytes.  No cipher is involved.
2. *Pages.*  The other words are read by pairs of known code pages, and each source's pairs are weighted by the words
   that they explain.  This gives priors only.
3. *Letters.*  For each source, P(letter | character) starts from those priors, with some probability for every letter of
   every page, so that a page that no list holds can be learned as well.  A word's odd characters are the symbols of a
   hidden Markov model whose states are letters and whose transitions are bigrams; forward and backward sums over all
   readings give each letter's part in it, and the parts of all words of the source make the next table.  ASCII stays
   as it is, as in every single-byte page.
4. A word is garbled if reading it by its source's table is far more probable than leaving it.  The table is applied
   with translate(); a word that it reads otherwise than its own best reading (a source with two wrong pages) keeps
   the latter.

Characters that are gone for good (replacement characters, question marks inside words) are named without repair.

Python sees each distinct word of a source once, and only words that aren't plain ASCII.  Bigrams are
kept in hashed tables of fixed size (BUCKETS); these and the matrix made of them over the pages' letters are what is
broadcast.  A source with many
words is divided into slices, each of which gets the source's table.
"""

from __future__ import annotations

import functools
import html
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, hot_join, hot_keys, table

#: Code pages (fixed values): those that texts are read by wrongly, and the own ones of texts by the page read.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "cp852", "koi8-r", "cp1253", "cp866", "cp1257", "cp1254", "cp932", "gbk", "iso8859-15", "iso8859-9"]
OWN = ["cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp1253", "iso8859-7", "cp1252", "mac_roman", "cp437", "cp850", "cp852", "cp866", "cp1257", "mac_cyrillic", "mac_latin2", "cp932", "euc_jp"]
#: Entries of the hashed bigram tables, how many tables there are (the least count holds, so that collisions don't make
#: rare pairs usual), and how many pairs the unconditional probability of a second letter is worth.
BUCKETS, TABLES, SMOOTH = 1 << 19, 3, 20.0
#: A word's occurrences count for bigrams up to so many times the mean of all words, so that a large group of copies
#: doesn't make up the language.
LEVEL = 32
#: A word is odd if one of its bigrams is less probable than this (natural logarithm), or if it may show the bytes of a
#: UTF-8 letter.  Odd words are weighted among themselves, too; others are read all the same.
ODD = -5.0
#: Rounds of expectation-maximization over pages and over letters, and the log odds that make a word garbled.
ROUNDS, LETTER_ROUNDS, ODDS = 3, 3, 3.0
#: What a reading by a page must gain at least to reach ODDS with all other evidence (at most KNOWN) for it.
KNOWN, UNKNOWN = 6.0, -6.0
LEAST_GAIN = ODDS - KNOWN
#: The log odds that make a word garbled by its source's letter table.
LETTER_ODDS = 3.0
#: Part of a symbol's prior that goes to letters that no pair of pages gives it, and how many words the prior is worth.
FREE, WORTH = 0.1, 1.0
#: Words of a source in a slice, and garbled words up to which they are broadcast to the items.
SLICE, SMALL = 20_000, 200_000
#: How often wrong decodings of a word are expected, against the word itself (natural logarithm), before learning.
PRIOR = -4.0

#: Blanks that divide words; white space above ASCII may be part of a garbled character.
_SPLIT = r"[ \t\n\r\f]+"
#: What makes a field garbled whatever its words: replacement and control characters, and question marks for letters.
_CONTROL = r"[\x00-\x08\x0e-\x1f\x7f\x80-\x84\x86-\x9f�]"
_LOST = r"[\p{L}\p{M}]\?+[\p{L}\p{M}]|(?:^|[\s(„“«‘])\?+\p{L}|\p{L}\?+ \p{Ll}|\s\?\s+\p{Ll}|\?{3,}"
_ENTITY = r"&#(?:1[2-9]\d|2[0-5]\d);"

#: Marks of clean text (fixed values); a key that makes letters of them counts only where it gives a known word.
_MARKS = set("…’‘“”„‚«»‹›–—•·£€¿¡§°©®™")
_LETTERS = regex.compile(r"\p{L}")
_TRIM = regex.compile(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
_NUMERIC = regex.compile(r"&#(\d{2,6});")
_TAGS = regex.compile(r"</?[A-Za-z][^<>]*>?")


def plain(word: str) -> str:
    """A word without markup, its numeric entities below 256 as characters."""
    if "<" in word:
        word = _TAGS.sub("", word)
    if "&" in word:
        word = html.unescape(_NUMERIC.sub(lambda m: chr(int(m[1])) if int(m[1]) < 256 else m[0], word))
    return word


def _bytes_of(chars: str, page: str) -> bytes | None:
    """Bytes that ``page`` reads as ``chars``; the control characters that lenient readers leave for bytes without a
    meaning in their page are taken as those bytes."""
    try:
        return chars.encode(page)
    except UnicodeError:
        out = bytearray()
        for c in chars:
            try:
                out += c.encode(page)
            except UnicodeError:
                if not "\x80" <= c <= "\x9f":
                    return None
                out.append(ord(c))
        return bytes(out)


@functools.lru_cache(maxsize=None)
def _reader(page: str) -> tuple[regex.Pattern, dict[str, int]]:
    """UTF-8 sequences as a single-byte page shows them."""
    show: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            show[bytes([b]).decode(page)] = b
        except UnicodeError:
            show[chr(b)] = b
    cls = lambda a, z: "[" + "".join(regex.escape(c) for c, b in show.items() if a <= b <= z) + "]"
    more = cls(0x80, 0xBF)
    return regex.compile(f"(?:{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{{2}}|{cls(0xF0, 0xF4)}{more}{{3}})+"), show


_MULTI = ("cp932", "gbk", "euc_jp")
#: What pages show for the first bytes of UTF-8 Latin letters and punctuation, with another such character after it.
_LEADS = {bytes([b]).decode(p, "ignore") for b in (0xC2, 0xC3, 0xC4, 0xC5, 0xE2) for p in READ_AS if p not in _MULTI}
_SHOWN_UTF8 = regex.compile("[" + "".join(sorted(c for c in _LEADS if not regex.match(r"\p{Greek}|\p{Cyrillic}", c))) + r"][^\x00-\x7f]")
_HIGH = regex.compile(r"[^\x00-\x7f]+")
_SINGLE = [p for p in READ_AS if p not in _MULTI]


def _from_utf8(word: str, page: str) -> str | None:
    """The word with UTF-8 read back where ``page`` shows it."""
    if page in _MULTI:
        def back(m):
            b = _bytes_of(m[0], page)
            try:
                return b.decode("utf-8") if b else m[0]
            except UnicodeError:
                return m[0]

        out = _HIGH.sub(back, word)
    else:
        pattern, show = _reader(page)

        def back(m):
            try:
                return bytes(show[c] for c in m[0]).decode("utf-8")
            except UnicodeError:
                return m[0]

        out = pattern.sub(back, word)
    return out if out != word else None


@functools.lru_cache(maxsize=None)
def swap_table(read: str, own: str) -> dict[int, str]:
    """Characters of the page read to those of the text's own page."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            a = bytes([b]).decode(read)
        except UnicodeError:
            a = chr(b)
        try:
            z = bytes([b]).decode(own)
        except UnicodeError:
            continue
        if a != z:
            out[ord(a)] = z
    return out


@functools.lru_cache(maxsize=None)
def _shown(page: str) -> frozenset[str]:
    """Characters above ASCII that a single-byte page can show."""
    return frozenset(_reader(page)[1])


def read_back(word: str) -> dict[str, str]:
    """What the word may be if characters of it are the bytes of a multi-byte encoding, by key: ``utf8:page``, joined by
    ``+`` for a text garbled again and again, or ``page>own``.  Each turn goes on from the readings that read most of the
    word back (the shortest ones), which ends it."""
    out: dict[str, str] = {}
    known = {word}
    front = {"": word}
    while front:
        new: dict[str, str] = {}
        for key, w in front.items():
            for page in READ_AS:
                r = _from_utf8(w, page)
                if r is not None and r not in known:
                    known.add(r)
                    new[f"{key}+utf8:{page}".lstrip("+")] = r
        out |= new
        least = min(map(len, new.values()), default=0)
        front = {key: w for key, w in new.items() if len(w) == least}
    for read, own in ((r, o) for r in _SINGLE for o in OWN if o in _MULTI) if not word.isascii() else ():
        try:
            r = _HIGH.sub(lambda m: _bytes_of(m[0], read).decode(own), word)
        except (UnicodeError, AttributeError, TypeError):
            continue
        if r not in known:
            known.add(r)
            out[f"{read}>{own}"] = r
    return out


def swapped(word: str) -> dict[str, str]:
    """What the word may be by the swaps of two single-byte pages, by key ``read>own``."""
    out: dict[str, str] = {}
    known = {word}
    high = {c for c in word if c > "\x7f"}
    for read in _SINGLE if high else []:
        if high <= _shown(read):
            for own in OWN:
                if own != read and own not in _MULTI and (r := word.translate(swap_table(read, own))) not in known:
                    known.add(r)
                    out[f"{read}>{own}"] = r
    return out


def readings(word: str) -> dict[str, str]:
    return {**swapped(word), **read_back(word)}


def bigrams(word: str) -> list[str]:
    w = "^" + _TRIM.sub("", word).lower() + "$"
    return [w[i : i + 2] for i in range(len(w) - 1)]


def _buckets(s: str) -> list[int]:
    b = s.encode("utf-8", "replace")
    return [zlib.crc32(b, i * 0x9E3779B1 & 0xFFFFFFFF) % BUCKETS + i * BUCKETS for i in range(TABLES)]


class Language:
    """Conditional bigram probabilities from hashed counts; singles are hashed beside pairs.  Pairs that are rare fall
    back to the probability of their second letter, so that a rare letter is improbable in any company."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.all, self.memo = counts, float(counts[:BUCKETS].sum()) / 2 + 1.0, {}

    def count(self, s: str) -> float:
        return float(min(self.counts[i] for i in _buckets(s)))

    def single(self, c: str) -> float:
        return (self.count(c) + 0.05) / self.all

    def logs(self, word: str) -> list[float]:
        out = []
        for g in bigrams(word):
            if g not in self.memo:
                if len(self.memo) > 1 << 20:
                    self.memo.clear()
                self.memo[g] = math.log((self.count(g) + SMOOTH * self.single(g[1])) / (self.count(g[0]) + SMOOTH))
            out.append(self.memo[g])
        return out


class Letters:
    """The hidden Markov model: states are the letters of the own pages (``letters``; ``at`` gives their place among
    the ``states``, which take upper and lower case as one), transitions are bigrams of ``lang``."""

    def __init__(self, lang: Language):
        shown = {c for p in _SINGLE for c in _shown(p)}
        self.letters = sorted({c for p in OWN if p not in _MULTI for c in _shown(p) if not "\x80" <= c <= "\x9f"})
        self.place = {c: i for i, c in enumerate(self.letters)}
        fold = lambda c: c.lower()[:1] or c
        every = sorted({fold(c) for c in {*shown, *self.letters, *map(chr, range(0x20, 0x7F))}} | {"^", "$"})
        self.index = {c: i for i, c in enumerate(every)}
        for c in shown.union(self.letters, map(chr, range(0x41, 0x5B))):
            self.index[c] = self.index[fold(c)]
        single = np.array([lang.single(c) for c in every])
        first = np.array([lang.count(c) for c in every])
        # Pairs of letters that don't occur have no count.
        met = np.flatnonzero(first > 0)
        pair = np.zeros((len(every), len(every)))
        for i in met:
            for j in met:
                pair[i, j] = lang.count(every[i] + every[j])
        self.p = (pair + SMOOTH * single) / (first[:, None] + SMOOTH)
        states = sorted({self.index[c] for c in self.letters})
        self.at = np.searchsorted(states, [self.index[c] for c in self.letters])
        self.n_states = len(states)
        self.into, self.within, self.out_of = self.p[:, states], self.p[np.ix_(states, states)], self.p[states, :]
        self.shown = shown
        self.log = np.log(self.p)

    def prior(self, pages: dict[str, float]) -> dict[str, np.ndarray]:
        """P(letter | symbol) by the weights of pairs of pages, over those that no pair is known for."""
        flat = {f"{r}>{o}": 1.0 for r in _SINGLE for o in OWN if o not in _MULTI and o != r}
        known = sum(pages.values())
        sure = known / (known + 1.0)
        out = {}
        for weights, part in ((flat, 1.0 - sure), (pages, sure)):
            total = sum(weights.values()) or 1.0
            for key, w in weights.items():
                read, own = key.split(">")
                swap = swap_table(read, own)
                for c in _shown(read):
                    i = self.place.get(swap.get(ord(c), c))
                    if i is not None:
                        if c not in out:
                            out[c] = np.zeros(len(self.letters))
                        out[c][i] += part * w / total
        upper = np.array([c.isupper() for c in self.letters])
        is_letter = np.array([bool(_LETTERS.match(c)) for c in self.letters], dtype=float)
        for c, v in out.items():
            same = np.where(upper == c.isupper(), 1.0, 0.1)
            if c in _MARKS:  # a mark for a mark changes no word, so nothing could tell
                v, same = v * is_letter, same * is_letter
            out[c] = (1 - FREE) * v / max(v.sum(), 1e-12) + FREE * same / same.sum()
        return out

    def run(self, before: int, symbols: str, after: int, table: dict[str, np.ndarray]) -> tuple[float, list[np.ndarray], str]:
        """A run of symbols between two known characters: log of the sum over all readings, each symbol's letters, and
        the best letters."""
        emit = [np.bincount(self.at, table[c], self.n_states) for c in symbols]
        log, forward = 0.0, []
        a = self.into[before] * emit[0]
        for i in range(len(symbols)):
            if i:
                a = (a @ self.within) * emit[i]
            s = a.sum()
            log += math.log(s)
            a = a / s
            forward.append(a)
        b = self.out_of[:, after]
        log += math.log(float(a @ b))
        parts: list[np.ndarray] = []
        for i in range(len(symbols) - 1, -1, -1):
            state = forward[i] * b
            state /= state.sum()
            e = emit[i]
            parts.append(table[symbols[i]] * (state / np.where(e > 0, e, 1.0))[self.at])
            if i:
                b = self.within @ (emit[i] * b)
                b /= b.max()
        parts.reverse()
        return log, parts, "".join(self.letters[int(v.argmax())] for v in parts)

    def word(self, word: str, table: dict[str, np.ndarray], memo: dict) -> tuple[float, list[tuple[str, np.ndarray]], str, bool] | None:
        """Log odds of the word read by the table against the word as it is, each symbol's letters, the best reading,
        and whether the word is odd; None for a word with characters that no single-byte page shows."""
        core = _TRIM.sub("", word)
        ids = []
        for c in core:
            i = self.index.get(c)
            if i is None or (c > "\x7f" and c not in table):
                return None
            ids.append(i)
        first, last = self.index["^"], self.index["$"]
        ids = [first, *ids, last]
        gain, parts, reading, at = 0.0, [], [], 0
        for m in _HIGH.finditer(core):
            a, z = m.span()
            key = (ids[a], m[0], ids[z + 1])
            if key not in memo:
                memo[key] = self.run(*key, table)
            log, letters, best = memo[key]
            gain += log - sum(self.log[ids[i], ids[i + 1]] for i in range(a, z + 1))
            parts += zip(m[0], letters)
            reading += [core[at:a], best]
            at = z
        if not parts:
            return None
        reading.append(core[at:])
        odd = min(self.log[i, j] for i, j in zip(ids, ids[1:])) < ODD
        return gain, parts, word.replace(core, "".join(reading), 1), bool(odd)


_WORD = pa.list_(pa.struct([("key", pa.string()), ("reading", pa.string()), ("gain", pa.float64())]))
_BY_TURNS = "source_id string, word string, reading string, symbol string, letter string, weight double"


def words_of(items: DataFrame) -> DataFrame:
    """(item_id, field_name, source_id, word): the words of titles and descriptions that aren't plain ASCII; items without
    a source are taken as one source, ''."""
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("title", "description")])
    rows = items.select("item_id", F.coalesce(F.col("source_id").cast("string"), F.lit("")).alias("source_id"), F.explode(fields).alias("f")).select("item_id", "source_id", "f.*")
    word = F.filter(F.split("text", _SPLIT), lambda w: F.octet_length(w) > F.length(w))
    entity = F.when(F.col("text").rlike(_ENTITY), F.filter(F.split("text", _SPLIT), lambda w: w.rlike(_ENTITY))).otherwise(F.array().cast("array<string>"))
    return rows.select("item_id", "source_id", "field_name", F.explode(F.concat(word, entity)).alias("word"))


def _evidence(gain: Column, least: float = 0.0) -> Column:
    """The bigrams, and the reading being a far more usual word, or (from ``least``) a far rarer one."""
    return gain + F.greatest(F.lit(least), F.least(F.lit(KNOWN), F.log((F.coalesce("known", F.lit(0)) + 0.5) / (F.col("n") + 0.5))))


def _core(c: str) -> Column:
    """A word without marks around it; marks alone as they are."""
    core = F.regexp_replace(c, r"^[^\p{L}]+|[^\p{L}]+$", "")
    return F.when(core == "", F.col(c)).otherwise(core)


class Learned:
    """What learn() gives: ``words`` (source_id, word, reading, key, odds) of the garbled words of each source, ``seen``
    (source_id, word, n) of all words read, and ``letters`` (source_id, symbol, letter, weight), each source's table."""

    def __init__(self, words: DataFrame, seen: DataFrame, letters: DataFrame):
        self.words, self.seen, self.letters = words, seen, letters


def learn(items: DataFrame) -> Learned:
    spark = items.sparkSession
    seen = cut(words_of(items).groupBy("source_id", "word").agg(F.count("*").alias("n")))
    vocabulary = cut(seen.groupBy("word").agg(F.sum("n").alias("n")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * TABLES)
        for b in batches:
            grams: Counter = Counter()
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in bigrams(plain(w)):
                    grams[g] += n
                    grams[g[0]] += n
                grams["$"] += n
            for g, n in grams.items():
                total[_buckets(g)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(BUCKETS * TABLES, dtype=np.float32)
    words, all_ = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(spark.sparkContext.defaultParallelism, words // SLICE + 1)
    weight = F.least(F.col("n"), F.lit(LEVEL * all_ / max(words, 1))).cast("double")
    sums = vocabulary.select("word", weight.alias("n")).mapInArrow(count, "bucket int, n double").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS x TABLES rows
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    known = cut(vocabulary.select(_core("word").alias("core"), "n").where("core <> ''").groupBy("core").agg(F.sum("n").alias("known")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = Language(shared.value)
        for b in batches:
            keep, rare, out = [], [], []
            for w in b.column(0).to_pylist():
                p = plain(w)
                own = lang.logs(p)
                escaped = p != w and bool(regex.search(_ENTITY, w))
                if not own:
                    continue
                odd = min(own) < ODD or escaped or bool(_SHOWN_UTF8.search(p))
                base = sum(own)
                found = []
                for key, r in readings(p).items():
                    # A swap of single letters is no word to judge by.
                    if ">" in key and (len(_LETTERS.findall(p)) < 2 or len(_LETTERS.findall(r)) < 2):
                        continue
                    if (gain := sum(lang.logs(r)) - base) > LEAST_GAIN:
                        found.append({"key": key, "reading": r, "gain": gain})
                if found:
                    keep.append(w)
                    out.append(found)
                    rare.append(odd)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string()), pa.array(rare, pa.bool_()), pa.array(out, _WORD)], ["word", "odd", "found"])

    ddl = "word string, odd boolean, found array<struct<key:string,reading:string,gain:double>>"
    read_ = vocabulary.select("word").repartition(slices).mapInArrow(read, ddl).select("word", "odd", F.explode("found").alias("f")).select("word", "odd", "f.*")
    read_ = cut(read_.withColumn("core", _core("reading")).join(known, "core", "left").drop("core"))
    cand = seen.join(read_, "word").select("source_id", "word", "n", "odd", "key", "reading", _evidence(F.col("gain")).alias("evidence"), F.coalesce("known", F.lit(0)).alias("known"))
    marks = "|".join(regex.escape(c) for c in sorted(_MARKS))
    cand = cand.where((F.col("evidence") > LEAST_GAIN) & ~(F.col("key").contains(">") & F.col("word").rlike(marks) & (F.col("known") < 3)))
    # Odd words are garbled far more often than others: they are weighted among themselves, and all words of a source
    # together, where a key that few words speak for counts less.
    among = F.explode(F.when(F.col("odd"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    cand = cut(cand.select("source_id", "word", "n", "key", "reading", "evidence", among.alias("among_odd")))
    group = ["source_id", "among_odd"]
    least = F.when(F.col("among_odd"), PRIOR - 2).otherwise(PRIOR - 4)
    weights = cand.select(*group, "key").distinct().withColumn("prior", F.lit(PRIOR))
    for _ in range(ROUNDS):
        scored = cand.join(weights, [*group, "key"]).withColumn("e", F.exp(F.least(F.lit(60.0), F.col("evidence") + F.col("prior"))))
        total = scored.groupBy(*group, "word").agg(F.sum("e").alias("all"), F.first("n").alias("n"))
        resp = scored.join(total.select(*group, "word", "all"), [*group, "word"]).withColumn("r", F.col("n") * F.col("e") / (1 + F.col("all")))
        by_key = resp.groupBy(*group, "key").agg(F.sum("r").alias("w"))
        stay = total.groupBy(*group).agg(F.sum(F.col("n") / (1 + F.col("all"))).alias("stay"))
        weights = cut(by_key.join(stay, group).select(*group, "key", F.col("w").alias("weight"), "stay", F.greatest(least, F.least(F.lit(0.0), F.log((F.col("w") + 0.1) / (F.col("stay") + 1.0)))).alias("prior")))
    # Among all words, a word doesn't speak for itself: its key is weighted by the source's other words.
    own = resp.select(*group, "word", "key", "evidence", "reading", "r").join(weights, [*group, "key"])
    others = F.greatest(least, F.least(F.lit(0.0), F.log((F.greatest(F.lit(0.0), F.col("weight") - F.col("r")) + 0.01) / (F.col("stay") + 1.0))))
    scored = own.withColumn("odds", F.col("evidence") + F.when(F.col("among_odd"), F.col("prior")).otherwise(others))
    many = F.col("key").contains("utf8:")
    for own_page in (p for p in OWN if p in _MULTI):
        many = many | F.col("key").endswith(">" + own_page)
    best = scored.where(F.col("odds") >= ODDS).groupBy("source_id", "word", many.alias("many")).agg(F.max(F.struct("odds", "key", "reading")).alias("b"))
    best = cut(best.select("source_id", "word", "many", "b.*"))
    back = best.where("many")
    words = seen.join(back.select("source_id", "word"), ["source_id", "word"], "left_anti").where(F.col("word").rlike(r"[^\x00-\x7f]"))
    # The pages' weights, by the words that have no better reading.
    pages = best.where("not many").join(back.select("source_id", "word"), ["source_id", "word"], "left_anti").groupBy("source_id", "key").agg(F.sum(F.lit(1.0)).alias("weight"))
    letters, garbled = _letters(cut(words), pages, known, spark.sparkContext.broadcast(Letters(Language(counts))))
    return Learned(back.select("source_id", "word", "reading", "key", "odds").unionByName(garbled), seen, letters)


def _letters(words: DataFrame, pages: DataFrame, known: DataFrame, model: Broadcast) -> tuple[DataFrame, DataFrame]:
    """The sources' letter tables, and their words that are garbled by them."""
    slices = words.groupBy("source_id").agg((F.floor(F.count("*") / SLICE) + 1).alias("slices"))
    words = cut(words.join(slices, "source_id").select("source_id", "word", "n", F.pmod(F.xxhash64("word"), F.col("slices")).alias("slice")))
    spread = cut(slices.select("source_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")))
    pages = pages.select("source_id", F.lit("").alias("symbol"), F.col("key").alias("letter"), "weight")

    def turn(last: bool):
        def run(mine: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
            hmm = model.value
            pairs, counts, rates = {}, {}, {"odd": math.exp(PRIOR), "all": math.exp(PRIOR)}
            for symbol, letter, weight in about[["symbol", "letter", "weight"]].itertuples(index=False):
                if symbol == "":
                    pairs[letter] = weight
                elif symbol == "\x00":
                    rates[letter] = weight
                else:
                    counts.setdefault(symbol, {})[letter] = weight
            table = hmm.prior(pairs)
            for symbol, by in counts.items():
                n = sum(by.values())
                v = WORTH * table[symbol]
                for letter, w in by.items():
                    v[hmm.place[letter]] += w
                table[symbol] = v / (WORTH + n)
            memo: dict = {}
            # Odd words are garbled far more often than others and weighted among themselves.
            priors = {k: math.log(v / (1 - v)) for k, v in rates.items()}
            out, total, sums = [], {}, {"odd": [0.0, 0.0], "all": [0.0, 0.0]}
            for w, n in mine[["word", "n"]].itertuples(index=False):
                p = plain(w)
                got = hmm.word(p, table, memo) if len(_LETTERS.findall(p)) >= 2 else None
                if got is None:
                    continue
                gain, parts, reading, odd = got
                prior = max(priors.values()) if odd else priors["all"]
                if last:
                    if reading != p and gain + prior > LEAST_GAIN:
                        out.append((w, reading, None, None, gain + prior))
                    continue
                r = 1 / (1 + math.exp(-max(-50.0, min(50.0, gain + prior))))
                share = math.sqrt(n)
                for k in ("odd", "all") if odd else ("all",):
                    sums[k][0] += r * share
                    sums[k][1] += share
                if r > 1e-3:
                    for symbol, v in parts:
                        if symbol in total:
                            total[symbol] = total[symbol] + r * share * v
                        else:
                            total[symbol] = r * share * v
            if not last:
                for symbol, v in total.items():
                    out += [(None, None, symbol, hmm.letters[i], float(v[i])) for i in np.flatnonzero(v > 1e-3)]
                for k, (gone, all_) in sums.items():
                    out += [(None, k, "\x00", "gone", gone), (None, k, "\x00", "all", all_)]
            at = mine["source_id"].iloc[0] if len(mine) else None
            return pd.DataFrame([(at, *o) for o in out], columns=["source_id", "word", "reading", "symbol", "letter", "weight"])

        return run

    def once(about: DataFrame, last: bool) -> DataFrame:
        told = about.join(spread, "source_id").select(F.col("source_id").alias("about"), F.col("slice").alias("part"), "symbol", "letter", "weight")
        return words.groupBy("source_id", "slice").cogroup(told.groupBy("about", "part")).applyInPandas(turn(last), _BY_TURNS)

    about = pages
    for _ in range(LETTER_ROUNDS):
        sums = cut(once(about, False).groupBy("source_id", "symbol", "letter", "reading").agg(F.sum("weight").alias("weight")))
        part = lambda x: F.sum(F.when(F.col("letter") == x, F.col("weight")).otherwise(0.0))
        rate = F.greatest(F.lit(math.exp(PRIOR - 4)), F.least(F.lit(0.5), (part("gone") + 0.1) / (part("all") + 1.0)))
        rate = sums.where("symbol = '\x00'").groupBy("source_id", "reading").agg(rate.alias("weight")).select("source_id", F.lit("\x00").alias("symbol"), F.col("reading").alias("letter"), "weight")
        table_ = sums.where("symbol <> '\x00'").drop("reading")
        about = cut(pages.unionByName(table_).unionByName(rate))
    letters = about.where("symbol not in ('', '\x00')")
    read_ = once(about, True).select("source_id", "word", "reading", F.col("weight").alias("gain")).join(words.select("source_id", "word", "n"), ["source_id", "word"])
    scored = read_.withColumn("core", _core("reading")).join(known, "core", "left").withColumn("odds", _evidence(F.col("gain"), UNKNOWN)).where(F.col("odds") >= LETTER_ODDS)
    marks = "|".join(regex.escape(c) for c in sorted(_MARKS))
    scored = scored.where(~F.col("word").rlike(marks) | (F.coalesce("known", F.lit(0)) >= 3))
    # The table as strings for translate(); a word keeps its own best reading where the table's is another.
    top = letters.groupBy("source_id", "symbol").agg(F.max_by("letter", "weight").alias("letter")).where("symbol <> letter")
    tables = top.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "letter"))).alias("t")).select("source_id", F.array_join("t.symbol", "").alias("symbols"), F.array_join("t.letter", "").alias("letters"))
    by_table = F.expr("translate(word, symbols, letters)")
    out = scored.join(tables, "source_id", "left").withColumn("same", F.coalesce(by_table == F.col("reading"), F.lit(False)))
    return letters, out.select("source_id", "word", F.when(F.col("same"), by_table).otherwise(F.col("reading")).alias("reading"), F.when(F.col("same"), "letters").otherwise("letters of the word").alias("key"), "odds")


def _hits(items: DataFrame, learned: Learned, *more: str) -> DataFrame:
    """(item_id, field_name, word, ...) of the garbled words in items: the few garbled words are broadcast while they are
    at most SMALL, else hot words are divided."""
    words = cut(learned.words.select("source_id", "word", *more).distinct())
    if words.count() <= SMALL:
        return words_of(items).join(F.broadcast(words), ["source_id", "word"])
    return hot_join(words_of(items), words, ["source_id", "word"], "item_id", hot_keys(learned.seen, ["source_id", "word"]), "inner")


def inspected(items: DataFrame) -> DataFrame:
    """(item_id, field_name, why) of the titles and descriptions that are garbled, wholly or in part: ``bytes`` (read back
    from a multi-byte encoding), ``letters`` (by its source's letter table), ``control`` (replacement and control
    characters), ``lost`` (question marks in place of letters), the first that applies.

    Null and empty fields are none; a row that comes twice is named once; extra columns are ignored.
    """
    why = F.when(F.col("key").startswith("letters"), 2).otherwise(1)
    rows = [_hits(items, learn(items), "key").select("item_id", "field_name", why.alias("why"))]
    for c in ("title", "description"):
        bare = F.regexp_replace(F.regexp_replace(c, r"https?://\S+", ""), r"<[^<>]*>", "")
        lost = F.when(F.col(c).rlike(_CONTROL), 3).when(F.col(c).contains("?") & bare.rlike(_LOST), 4)
        rows.append(items.select("item_id", F.lit(c).alias("field_name"), lost.alias("why")).where("why is not null"))
    found = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("item_id", "field_name").agg(F.min("why").alias("why"))
    return found.withColumn("why", F.element_at(F.array(*map(F.lit, ("bytes", "letters", "control", "lost"))), F.col("why")))


def garbled_fields(items: DataFrame) -> DataFrame:
    """(item_id, field_name) of inspected()."""
    return inspected(items).select("item_id", "field_name")


def repaired(items: DataFrame) -> DataFrame:
    """(item_id, field_name, text): garbled fields with their words restored where that can be done."""
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("title", "description")])
    rows = items.select("item_id", F.explode(fields).alias("f")).select("item_id", "f.*")
    hits = _hits(items, learn(items), "reading").groupBy("item_id", "field_name").agg(F.collect_set(F.struct("word", "reading")).alias("pairs"))
    longest = F.expr("array_sort(pairs, (a, b) -> length(b.word) - length(a.word))")
    fixed = F.aggregate(longest, F.col("text"), lambda t, p: F.replace(t, p.word, p.reading))
    return rows.join(hits, ["item_id", "field_name"]).select("item_id", "field_name", fixed.alias("text"))


def letter_table(learned: Learned) -> DataFrame:
    """(source_id, symbol, letter, weight): what a source's characters stand for, the likeliest letter of each."""
    top = learned.letters.groupBy("source_id", "symbol").agg(F.max(F.struct("weight", "letter")).alias("m"))
    return top.select("source_id", "symbol", F.col("m.letter").alias("letter"), F.round("m.weight", 3).alias("weight")).where("symbol <> letter and weight >= 1")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_fields(table(spark, sf_dir, "feed_items"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "feed_items"))


def p6_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letter_table(learn(table(spark, sf_dir, "feed_items")))
