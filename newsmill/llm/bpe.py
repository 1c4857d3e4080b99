"""Problem 8: token ids of whole texts by a public byte-level BPE.

Words are cut off by the vocabulary's own pattern; each distinct word is merged once per worker and kept.  Merging
holds two contiguous arrays per word: the boundaries of the parts and the rank of each adjacent pair.  The least
rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed.  A scan costs the length of
the word, so words above LONG bytes (runs without spaces, such as whole Japanese sentences) use a heap over linked
parts instead, with the same result.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: Where the vocabularies lie, and the one used; both are parameters.
TOKENIZERS = os.environ.get("NEWSMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges (a fixed value that belongs to the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a word from which a heap is used.
LONG = 96
#: Words whose ids a worker keeps; the store is emptied when full, so memory stays bounded.
KEPT_WORDS = 200_000
_NONE = 1 << 60


class Bpe:
    """Encoder of one rank file: lines of base64 bytes and their rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._long(word) if len(word) > LONG else self._short(word)

    def _short(self, word: bytes) -> list[int]:
        rank_of = self.ranks.get
        bounds = list(range(len(word) + 1))
        ranks = [rank_of(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(word[bounds[i - 1] : bounds[i + 1]], _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(word[bounds[i] : bounds[i + 2]], _NONE)
        return [self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _long(self, word: bytes) -> list[int]:
        rank_of, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start of a part: its end, the start before it
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if not alive[i] or mid >= n or after[mid] != end:
                continue  # a pair that is gone
            alive[mid], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := rank_of(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank_of(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [self.ranks[word[i : after[i]]] for i in range(n) if alive[i]]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, no special tokens; none for null and empty text."""
        out: list[int] = []
        if not text:
            return out
        kept, add = self.kept, out.extend
        for w in self.split(text):
            ids = kept.get(w)
            if ids is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                ids = self.merge(w.encode("utf-8", "replace"))
                if len(w) <= LONG:
                    kept[w] = ids
            add(ids)
        return out


@functools.lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Bpe:
    """One encoder per worker process."""
    return Bpe(os.path.join(folder, name))


def encode(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>), one row for each row of ``df``.

    Null and empty texts give an empty list; repeated rows and keys are kept; other columns are ignored; an empty
    table gives an empty result.  No shuffle: each task turns its own rows, and holds one batch of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, name)
        for b in batches:
            ends, parts, total = [0], [], 0
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                total += len(ids)
                ends.append(total)
                parts.append(np.asarray(ids, dtype=np.int32))
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens int); as encode(), without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, name)
        for b in batches:
            sizes = [len(bpe.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32())], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
