import base64
import os
import random

import pytest

from newsmill.llm import bpe, packing

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    with open(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rnd = random.Random(7)
    ranges = [(32, 127), (32, 0x250), (0x370, 0x500), (0x3040, 0x3100), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (0x2000, 0x2070)]
    out = ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(0, 300))) for _ in range(300)]
    return out + ["", " ", "\r\n\n \t", "<|endoftext|>", "a" * 5_000, "ab" * 3_000, "水" * 700, "don't we'll I'VE", "x\x00y�", " " * 400 + "x"]


def test_ids_are_those_of_the_public_encoder(reference):
    e = bpe.encoder()
    assert [e.encode(t) for t in _texts()] == [reference.encode_ordinary(t) for t in _texts()]


def test_short_and_long_merges_agree():
    e = bpe.encoder()
    for t in _texts():
        for w in e.split(t):
            b = w.encode("utf-8", "replace")
            if len(b) < 400 and b not in e.ranks:
                assert e._short(b) == e._long(b)


def test_table(spark, data, reference):
    rows = [(1, "one two", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, " ", 5)]
    got = [(r.doc_id, r.ids) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), "doc_id", "text").collect()]
    assert sorted(got) == sorted((k, reference.encode_ordinary(t or "")) for k, t, _ in rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: r.ids for r in bpe.p8_ids(spark, data).collect()} == {k: reference.encode_ordinary(t or "") for k, t in docs.items()}


def _check(got, sizes, capacity):
    fill, seen = {}, {}
    for k, piece, container in got:
        left = sizes[k] - piece * capacity
        fill[container] = fill.get(container, 0) + min(left, capacity)
        seen.setdefault(k, []).append(piece)
    assert all(v <= capacity for v in fill.values())
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(-(-n // capacity))) for k, n in sizes.items() if n}
    assert sorted(fill) == list(range(len(fill)))
    return len(fill)


@pytest.mark.parametrize("seed", range(4))
def test_packing(spark, seed):
    rnd = random.Random(seed)
    sizes = {i: rnd.choice([0, 1, rnd.randrange(1, 60), rnd.randrange(1, 500), 34]) for i in range(1_500)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(9_999, None, "x")], "doc_id long, n_tokens int, size string")
    got = [tuple(r) for r in packing.pack(df, "doc_id", capacity=100).collect()]
    least = -(-sum(sizes.values()) // 100)
    assert _check(got, sizes, 100) <= least * 1.03 + 1
    assert sorted(got) == sorted(tuple(r) for r in packing.pack(df, "doc_id", capacity=100).collect())


def test_packing_of_nothing_and_one(spark):
    schema = "doc_id long, n_tokens int"
    assert packing.pack(spark.createDataFrame([], schema), "doc_id").count() == 0
    got = [tuple(r) for r in packing.pack(spark.createDataFrame([(1, 5_000)], schema), "doc_id").collect()]
    assert _check(got, {1: 5_000}, 2048) == 3


def test_bounds_are_optimal():
    import itertools

    rnd = random.Random(1)
    for _ in range(20):
        h = {rnd.randrange(1, 40): rnd.randrange(1, 9) for _ in range(8)}
        s = sorted(h)
        cost = lambda b: sum(n * (min(x for x in b if x >= v) - v) for v, n in h.items())
        best = min(cost([*c, s[-1]]) for k in range(3) for c in itertools.combinations(s[:-1], k))
        assert cost(packing.bucket_bounds(h, 3)) == best
