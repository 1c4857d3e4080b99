import random

import pytest

from newsmill.llm import repetition as R


def _brute(text):
    words = R._words(text)
    units = R._units(words)
    n = R.PASSAGE_WORDS if units is words else R.PASSAGE_LETTERS
    covered = set()
    for i in range(len(units) - n + 1):
        if any(units[j : j + n] == units[i : i + n] for j in range(i)):
            covered |= set(range(i, i + n))
    total = sum(map(len, units))
    return sum(len(units[i]) for i in covered) / total if total else 0.0


def test_share_is_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        words = [rnd.choice(["alpha", "be", "c", "Δ", "x1y"]) for _ in range(rnd.randrange(0, 60))]
        text = " ".join(words)
        assert R.passage_share(text) == pytest.approx(_brute(text))
    ja = "水道局は桟橋の売却を取りやめた。" * 3
    assert R.passage_share(ja) == pytest.approx(_brute(ja)) and R.passage_share(ja) > 0.6


def test_what_does_not_count():
    a = "One two three four five six seven eight"
    assert R.passage_share(f"{a}. 12 {a.upper()}, 7!") == 0.5
    assert R.passage_share("one two three four five six seven " * 1) == 0.0
    for t in (None, "", "  \n", "123 456", "x" * 100_000):
        assert R.passage_share(t) == 0.0


def test_ledger(spark):
    again = "one two three four five six seven eight nine ten\n" * 4
    rows = [(1, again, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (1, again, 0)]
    led = R.ledger(spark.createDataFrame(rows, "doc_id long, text string, bits int"), "doc_id", "text")
    assert sorted(r.doc_id for r in led.where(R.fails(1)).collect()) == [1, 1]
    got = {r.rule: (r.failing, r.only_this) for r in R.ablation(led, 2).collect()}
    assert got["passages"] == (2, 0) and got["lines"] == (2, 0) and got["paragraphs"] == (0, 0)
    assert R.ledger(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_texts_of_two_scripts():
    ja = "市議会は新しい図書館の建設計画を延期すると発表した。"
    names = "Dentgarth Tronholm Foambecombe Saesso Vollick Haellmere Vorveridge Leinholm Paenefell Stiredale Grumbor"
    # Names in Latin letters don't make a Japanese text one of words.
    mixed = "".join(f"{n}の{ja}" for n in names.split())
    assert R.passage_share(mixed) > 0.6
    # Each half by its own passage.
    en = "the council put off the plan for a new library until the spring of next year"
    other = "a bakery in the old town sells bread to the ferry crews every night and day"
    whole = f"{en} {other} {ja}{ja}"
    assert R.passage_share(whole) == pytest.approx(25 / len("".join(R._words(whole))))
    assert R.passage_share(f"{ja}{ja[::-1]} {en} {en}") > 0.2
    assert R.passage_share(f"{en} {other} 市議会は 市議会は") == 0.0
