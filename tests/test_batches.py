import random

from newsmill.operators.batches import first_seen


def _fold(rows):
    seen, kept = set(), {}
    for i, a, b in sorted(rows):
        keys = {(n, k) for n, k in enumerate((a, b)) if k is not None}
        kept[i] = not keys & seen
        if kept[i]:
            seen |= keys
    return kept


def test_first_seen_is_the_fold(spark):
    rnd = random.Random(5)
    for n in (1, 40, 300):
        rows = [(i, rnd.choice([None, *"abcdefghij"[: 2 + n // 40]]), rnd.choice([None, f"g{rnd.randrange(n)}"])) for i in range(n)]
        got = {r.i: r.kept for r in first_seen(spark.createDataFrame(rows, "i long, a string, b string"), "i", ["a", "b"]).collect()}
        assert got == _fold(rows)


def test_chain_and_empty(spark):
    rows = [(1, "x", "g"), (2, "x", "h"), (3, "y", "h"), (4, "y", "k"), (5, "z", "k"), (6, None, None)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    assert {r.i: r.kept for r in first_seen(df, "i", ["a", "b"]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}
    assert first_seen(df.limit(0), "i", ["a", "b"]).count() == 0
