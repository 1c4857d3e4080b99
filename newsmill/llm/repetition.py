"""Problem 10: repetition inside one document, as a ledger of rules.

Every rule is evaluated once for each document; its failure is a bit of ``bits`` and what it measured a column.
Policies are masks over the bits, kept by version; applying one, or leaving rules out to see what they alone catch,
only reads the ledger.
"""

from __future__ import annotations

import itertools
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: A passage is so many words, or letters where a script has no spaces.
PASSAGE_WORDS, PASSAGE_LETTERS = 8, 15
#: A text is one of a script without spaces from 1/DENSE of its letters.
DENSE = 4
#: Rules: name, measure, and the least value that fails.  A rule's place is its bit and never changes.
RULES = [
    ("passages", "passage_share", 0.3),
    ("lines", "line_share", 0.3),
    ("paragraphs", "paragraph_share", 0.3),
    ("top_word", "top_word_share", 0.3),
    ("few_words", "word_repeat_share", 0.9),
]
#: Policies by version: the mask of the rules that exclude a document.
POLICIES = {1: 0b00001, 2: 0b00111, 3: 0b11111}
_MEASURES = [m for _, m, _ in RULES]

_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー]")
_DENSE_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー]{15,}")
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}\s]+")


def _words(text: str) -> list[str]:
    return _NO_LETTER.sub("", unicodedata.normalize("NFKC", text).casefold()).split()


def _dense(letters: str) -> int:
    return 0 if letters.isascii() else len(_SPACELESS.findall(letters))


def _units(words: list[str]) -> list[str]:
    """The words of a text, or its letters where a quarter of them or more are of a script without spaces (names in
    other letters stand in such texts)."""
    letters = "".join(words)
    return list(letters) if letters and _dense(letters) * DENSE >= len(letters) else words


def _again(grams: list) -> list[int]:
    """Places of the grams that occurred before."""
    if len(set(grams)) == len(grams):
        return []
    seen: set = set()
    out = []
    for i, g in enumerate(grams):
        if g in seen:
            out.append(i)
        else:
            seen.add(g)
    return out


def _word_grams(words: list[str]) -> list[bytes]:
    """Runs of words as the bytes of their numbers."""
    numbers: dict[str, int] = {}
    ids = array("I", [numbers.setdefault(w, len(numbers)) for w in words])
    return [ids[i : i + PASSAGE_WORDS].tobytes() for i in range(len(words) - PASSAGE_WORDS + 1)]


def _repeated(words: list[str]) -> float:
    """Share of the letters in passages that occurred before.  In a text of a script without spaces passages are runs of
    letters, and of words where it holds so many without such a letter; in other texts they are runs of words, and of
    letters where so many of such a script stand together."""
    letters = "".join(words)
    dense = _dense(letters)
    by_letter = bool(letters) and dense * DENSE >= len(letters)
    marks: list[tuple[int, int]] = []
    if len(words) > PASSAGE_WORDS:
        at = [0, *itertools.accumulate(map(len, words))]
        plain = [not dense or not _SPACELESS.search(w) for w in words] if by_letter else []
        if not by_letter or sum(plain) > PASSAGE_WORDS:
            marks += [(at[i], at[i + PASSAGE_WORDS]) for i in _again(_word_grams(words)) if not by_letter or all(plain[i : i + PASSAGE_WORDS])]
    if dense and len(letters) > PASSAGE_LETTERS:
        runs = [(0, len(letters))] if by_letter else [m.span() for m in _DENSE_RUN.finditer(letters)]
        places = [i for a, z in runs for i in range(a, z - PASSAGE_LETTERS + 1)]
        marks += [(places[j], places[j] + PASSAGE_LETTERS) for j in _again([letters[i : i + PASSAGE_LETTERS] for i in places])]
    covered, until = 0, 0
    for a, z in sorted(marks):
        covered += max(0, z - max(a, until))
        until = max(until, z)
    return covered / len(letters) if letters else 0.0


def passage_share(text: str | None) -> float:
    """Characters of words in passages that occurred before in the text, over the characters of all words; 0 where
    there is no word.  Passages may overlap; a character counts once."""
    return _repeated(_words(text)) if text else 0.0


def _share_again(parts: list[str]) -> float:
    total, again, seen = 0, 0, set()
    for p in parts:
        k = " ".join(p.split()).casefold()
        if k:
            total += len(k)
            again += len(k) * (k in seen)
            seen.add(k)
    return again / total if total else 0.0


def _measure(text: str | None) -> tuple[float, ...]:
    if not text or not text.strip():
        return (0.0,) * len(RULES)
    words = _words(text)
    units = _units(words)
    counts = Counter(units)
    top = max(counts.values()) / len(units) if len(units) >= 20 else 0.0
    few = 1 - len(counts) / len(units) if len(units) >= 20 else 0.0
    return _repeated(words), _share_again(text.splitlines()), _share_again(regex.split(r"\n\s*\n", text)), top, few


def ledger(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bits, one measure for each rule), one row for each row of ``df``.

    Null, empty and blank texts measure 0 everywhere and fail nothing; repeated rows are kept; other columns are
    ignored.  No shuffle; each document is handled alone, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*map(_measure, b.column(1).to_pylist()))) or [()] * len(RULES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(m), pa.float64()) for m in got)], [key, *_MEASURES])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{m} double" for m in _MEASURES))
    bits = F.lit(0)
    for i, (_, m, least) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.col(m) >= least, 1 << i).otherwise(0))
    return out.withColumn("bits", bits)


def fails(version: int) -> Column:
    """Whether a row of the ledger is excluded by the policy of that version."""
    return F.col("bits").bitwiseAND(POLICIES[version]) != 0


def ablation(led: DataFrame, version: int) -> DataFrame:
    """One row for each rule of a policy: documents that fail it, and those that no other rule of the policy fails
    (what leaving it out would let in).  One aggregation over bits; at most one row a distinct bit set is shuffled."""
    mask = POLICIES[version]
    sets = led.groupBy(F.col("bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = led.sparkSession.createDataFrame([(name, 1 << i) for i, (name, _, _) in enumerate(RULES) if mask >> i & 1], "rule string, bit int")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        rules.crossJoin(sets)  # at most 5 rules x 32 bit sets
        .groupBy("rule", "bit")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"))
        .drop("bit")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(table(spark, sf_dir, "documents"), "doc_id", "text").where(fails(1)).select("doc_id")


def p10_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents"), "doc_id", "text"), 3)
