"""Problem 9: items of varying length into containers of fixed capacity.

Sizes are tokens; their histogram over the whole corpus has at most ``capacity`` rows, so it is the one thing that
goes to the driver.  Dynamic programming over it chooses the boundaries of length buckets with the least padding
(sizes rounded up to their bucket's bound).  Then, bucket by bucket, longest first:

1. *Closing rooms.*  The items of the bucket, longest first, are offered the rooms that the batches of longer buckets
   left, best fit first.
2. *Batches.*  What is left forms token-budget batches inside the bucket, best fit first among the bucket's own.

Without the first step (``buckets_only=True``) a container of long items keeps the room that no other item of its bucket
fits; the README has figures of both.

The plan is made of runs, "items number a to b of size s go to containers c, c+1, ...", and is a few thousand rows
whatever the corpus; items are numbered inside their size in parallel, by a hash of their id, and look up their run.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table
from .bpe import count_tokens

CAPACITY = 2048
BUCKETS = 16
#: Items of one size that are numbered in one task, about: a size is divided into as many shares as that takes.
SHARE = 500_000


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding."""
    sizes = sorted(s for s, n in histogram.items() if n > 0 and s > 0)
    if not sizes:
        return []
    m, k = len(sizes), min(buckets, len(sizes))
    s = np.array([0, *sizes], dtype=float)
    n = np.concatenate([[0.0], np.cumsum([histogram[x] for x in sizes])])
    w = np.concatenate([[0.0], np.cumsum([histogram[x] * x for x in sizes])])
    best, choice = np.full(m + 1, np.inf), np.zeros((k + 1, m + 1), dtype=int)
    best[0] = 0
    for b in range(1, k + 1):
        new = np.full(m + 1, np.inf)
        for j in range(1, m + 1):
            cost = best[:j] + (n[j] - n[:j]) * s[j] - (w[j] - w[:j])  # sizes i+1..j padded to the j-th
            i = int(np.argmin(cost))
            new[j], choice[b][j] = cost[i], i
        best = new
    bounds, j = [], m
    for b in range(k, 0, -1):
        bounds.append(sizes[j - 1])
        j = int(choice[b][j])
        if not j:
            break
    return bounds[::-1]


class _Rooms:
    """Containers by the room left in them: (first container, how many)."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.by:
                self.by[gap] = []
                bisect.insort(self.gaps, gap)
            self.by[gap].append((first, count))

    def best(self, size: int) -> tuple[int, int, int] | None:
        """The least room that the size fits, taken out."""
        i = bisect.bisect_left(self.gaps, size)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        first, count = self.by[gap].pop()
        if not self.by[gap]:
            del self.by[gap], self.gaps[i]
        return gap, first, count

    def take(self, other: _Rooms) -> None:
        for gap, rooms in other.by.items():
            for first, count in rooms:
                self.leave(gap, first, count)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, buckets: int = BUCKETS, buckets_only: bool = False) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first, length, container, per) and the number of containers: items ``first`` up to ``first +
    length`` of a size go to ``container + (number - first) // per``."""
    bounds = bucket_bounds(histogram, buckets)
    runs: list[tuple[int, int, int, int, int]] = []
    opened, bucket = 0, -1
    longer, own = _Rooms(), _Rooms()
    for size in sorted((s for s, n in histogram.items() if n > 0 and s > 0), reverse=True):
        here = bisect.bisect_left(bounds, size)
        if here != bucket:
            if not buckets_only:
                longer.take(own)
            bucket, own = here, _Rooms()
        todo, done = histogram[size], 0
        for rooms in (longer, own):
            while todo and (found := rooms.best(size)):
                gap, first, count = found
                per = min(gap // size, max(1, -(-todo // count)))  # as many as still fit into each
                used = min(count, todo // per)
                if not used:
                    used, per = 1, todo
                rooms.leave(gap, first + used, count - used)
                runs.append((size, done, used * per, first, per))
                rooms.leave(gap - per * size, first, used)
                done, todo = done + used * per, todo - used * per
        if todo:
            per = capacity // size
            full = todo // per
            if full:
                runs.append((size, done, full * per, opened, per))
                own.leave(capacity - per * size, opened, full)
                done, opened = done + full * per, opened + full
            if rest := todo - full * per:
                runs.append((size, done, rest, opened, rest))
                own.leave(capacity - rest * size, opened, 1)
                opened += 1
    return runs, opened


def pieces(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, size): items above the capacity are cut into full pieces and a rest; sizes of 0 or null give no
    piece."""
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("n_tokens") % capacity
    all_ = F.concat(F.array_repeat(F.lit(capacity), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    return sizes.where("n_tokens > 0").select(key, F.posexplode(all_).alias("piece", "size"))


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, buckets: int = BUCKETS, buckets_only: bool = False, share: int = SHARE) -> DataFrame:
    """(key, piece, container bigint) of (key, n_tokens).

    Null and zero sizes take no place; a key that comes twice is placed twice; an empty table gives an empty result.
    The placing is the same at every run over the same rows.  Numbering shuffles (key, piece, size) once, by size
    and a hash of the key, so that a size which a third of all items have is divided.
    """
    rows = cut(pieces(sizes, key, capacity))
    spark = rows.sparkSession
    totals = rows.groupBy("size").agg(F.count("*").alias("n"))  # at most capacity rows
    shares = spark.createDataFrame([(s, n // share + 1) for s, n in totals.collect()], "size int, shares bigint")
    rows = rows.join(F.broadcast(shares), "size").withColumn("share", F.pmod(F.xxhash64(key, "piece"), F.col("shares")).cast("int")).drop("shares")
    counts = rows.groupBy("size", "share").agg(F.count("*").alias("n"))  # at most capacity rows, and one for each SHARE items
    grid = {}
    for size, part, n in counts.collect():
        grid.setdefault(size, {})[part] = n
    runs, _ = plan({s: sum(by.values()) for s, by in grid.items()}, capacity, buckets, buckets_only)
    before = {s: np.concatenate([[0], np.cumsum([by.get(i, 0) for i in range(max(by) + 1)])[:-1]]) for s, by in grid.items()}
    grouped: dict[int, list] = {}
    for s, *r in runs:
        grouped.setdefault(s, []).append(r)
    by_size = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rs))) for s, rs in grouped.items()}
    shared = spark.sparkContext.broadcast((before, by_size))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, plans = shared.value
        for b in batches:
            out = np.empty(len(b), dtype=np.int64)
            size, share, rank = b["size"].to_numpy(), b["share"].to_numpy(), b["rank"].to_numpy()
            for s in np.unique(size):
                at = size == s
                number = offsets[s][share[at]] + rank[at]
                first, _, container, per = plans[s]
                i = np.searchsorted(first, number, side="right") - 1
                out[at] = container[i] + (number - first[i]) // per[i]
            yield pd.DataFrame({key: b[key], "piece": b["piece"], "container": out})

    w = Window.partitionBy("size", "share").orderBy(key, "piece")
    kind = rows.schema[key].dataType.simpleString()
    return rows.withColumn("rank", F.row_number().over(w) - 1).mapInPandas(place, f"`{key}` {kind}, piece int, container bigint")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
