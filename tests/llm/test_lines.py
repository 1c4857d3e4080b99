import random
import re
from collections import defaultdict

from newsmill.llm import boilerplate as B
from newsmill.llm import maintext as M

SCHEMA = "id long, url string, body string, node string, line_no string"


def _pages(n=60):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        host = rnd.choice(["www.a.example", "m.A.example:443", "b.example"])
        lines = [rnd.choice(["Share  this", "share THIS", "Read 3 more", "READ 77 more", f"own line {'x' * i}", "", " \t", "© 2024 A"]) for _ in range(rnd.randrange(0, 9))]
        rows.append((i, rnd.choice([f"https://{host}/p/{i}", f"http://{host}/q/{i}?x=1"]), rnd.choice(["\n", "\r\n"]).join(lines), "x", "y"))
    return rows + [(900, None, "Share this\nx", "x", "y"), (901, "https://b.example/", None, "x", "y"), (902, "n/a", "Share this", "x", "y")]


def _brute(rows):
    at, docs = [], defaultdict(set)
    for i, url, body, *_ in rows:
        m = re.match(r"https?://([^/:]+)", url or "")
        for no, line in enumerate((body or "").split("\n"), 1):
            k = re.sub(r"\d+", "0", " ".join(line.split()).lower())
            if m and k:
                site = re.sub(r"^(www|m|amp)\.", "", m[1].lower())
                docs[site, k].add(i)
                at.append((i, no, site, k))
    return {(i, no) for i, no, site, k in at if len(docs[site, k]) >= 5}


def test_repeated_lines_are_brute_force(spark):
    rows = _pages()
    got = {(r.id, r.line_no) for r in B.repeated_lines(spark.createDataFrame(rows, SCHEMA), "id", "url", "body").collect()}
    assert got == _brute(rows) and got


def test_blocks_and_removal(spark):
    rows = [(i, f"https://a.example/{i}", f"Menu {i}\nShop\nOwn text {'z' * i}\nTerms\nPrivacy", "", "") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = B.cut(B.lines_of(df, "id", "url", "body"))
    found, edges = B.blocks(lines, "id")
    assert sorted(r.n for r in found.groupBy("block").agg(B.F.count("*").alias("n")).collect()) == [4] or found.select("block").distinct().count() <= 2
    out = {r.id: r.body for r in B.without_blocks(df, "id", "body", B.occurrences(lines, found, "id")).collect()}
    assert out[3] == "Own text zzz"


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101)], "a long, b long")
    got = {r.node: r.block for r in B.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, url string, title string, body string")
    assert B.repeated_lines(none, "id", "url", "body").count() == 0
    assert M.furniture_lines(none, "id", "url", "title", "body").count() == 0


def test_lcs():
    rnd = random.Random(6)
    for _ in range(100):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(9))] for _ in range(2))
        pairs = M.lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def _article(i, rnd):
    names = ["Anna Bell", "Carl Dorn", "Eva Fint", "Gus Holm"]
    paras = [f"The {rnd.choice(['harbour', 'school', 'council', 'bakery'])} of {rnd.choice(names)} said on day {rnd.randrange(99)} that {' '.join(rnd.choice(['work', 'money', 'time', 'stone', 'water', 'light']) for _ in range(20))} would be needed before long." for _ in range(4)]
    mid = [f"What {''.join(rnd.choice('abcdefgh') for _ in range(9)).title()} wants"]
    teasers = [f"Why {rnd.choice(names)} saves the old mill for good – {rnd.choice(names)}" for _ in range(2)]
    lines = ["Home | News | Sport", f"By {rnd.choice(names)}, staff writer", *paras[:2], *mid, *paras[2:], "Read next", *teasers, "Terms and privacy"]
    own = set(range(3, 8))
    return (i, f"https://a.example/2024/{i:03d}", f"Why {rnd.choice(names)} saves the old mill for good", "\n".join(lines)), own


def test_furniture_of_a_site(spark):
    rnd = random.Random(8)
    pages = [_article(i, rnd) for i in range(40)]
    extra = [(900, "https://a.example/x", "t", None), (901, "https://a.example/y", "t", ""), (902, "https://a.example/z", "t", "Home | News | Sport\nTerms and privacy")]
    df = spark.createDataFrame([p for p, _ in pages] + extra, "id long, url string, title string, body string")
    got = defaultdict(set)
    for r in M.furniture_lines(df, "id", "url", "title", "body").collect():
        got[r.id].add(r.line_no)
    assert not {900, 901, 902} & set(got)
    for (i, _, _, body), own in pages:
        assert got[i] == set(range(1, len(body.split("\n")) + 1)) - own


def test_neighbours_of_a_line_up():
    at = {i: ("s" if i < 30 else "t", f"a{i}", None, (1, i + 10, 2)) for i in range(40)}
    at[12] = ("s", "a12", "head", (1, 22, 2))
    up = M.LineUp(at)
    assert list(up.near(10, True, "s", "a10", None)) == [9, 8, 7, 6, 5, 4, 11, 12, 13, 14, 15, 16]
    assert list(up.near(10, False, "s", "copy", "head")) == [10, 9, 8, 7, 6, 5, 11, 13, 14, 15, 16, 17]
    assert list(up.near(28, True, "s", "a28", None)) == [27, 26, 25, 24, 23, 22, 29]
    assert up.times(10, True, "s", "a10", None, at[10][3]) == {0: 12, 2: 12}
    assert up.times(10, False, "s", "copy", None, (7, 1)) == {1: 12}


def test_result_does_not_depend_on_partitions(spark):
    rnd = random.Random(12)
    pages = [_article(i, rnd)[0] for i in range(300)]
    # A third are copies of one article, some under its title alone; one page has no address.
    pages += [(1000 + i, "https://a.example/2024/007?x=%d" % i, pages[7][2], pages[7][3] + ("\nEnd" if i % 2 else "")) for i in range(150)]
    pages += [(2000, None, None, pages[3][3])]
    df = spark.createDataFrame(pages, "id long, url string, title string, body string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("2", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({(r.id, r.line_no) for r in M.furniture_lines(df, "id", "url", "title", "body").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] and got[0] == got[1] == got[2]
