import pytest
from newsmill.operators import discovery as D
from newsmill.sources import relations as R
from pyspark.sql import functions as F

CASES = [
    ("https://www.x.example/2024/05/06/a-long-slug-here", "x.example", 20 + 15 + 25, None, True),
    ("https://x.example/sport/short", "x.example", 20 + 15 + 10 + 15, None, True),
    ("https://x.example/short", "x.example", 35, None, False),
    ("https://x.example/About-us/team-of-people", "x.example", 0, "about_page", True),
    ("https://x.example/", "x.example", 0, "homepage", False),
    ("https://y.example/a/b", "x.example", 0, "different_domain", False),
    ("not an address", "x.example", 0, "invalid_url", False),
    (None, None, 0, "invalid_url", False),
    ("https://x.example/sportive", "x.example", 35, None, False),
]


def test_scores(spark):
    df = D.with_link(spark.createDataFrame([(i, *x) for i, x in enumerate(CASES)], "i int, url string, site string, score int, why string, article boolean"), "url")
    s = D.link_score(D.link_signals(F.col("site"), F.lit("/sport"), F.lit(None).cast("string"), F.lit("")))
    got = df.select("*", s.alias("s"), D.rejection(F.col("site"), s).alias("r"), D.is_article_like(F.col("site")).alias("a")).orderBy("i").collect()
    assert [(r.s, r.r, r.a) for r in got] == [x[2:] for x in CASES]


def test_redirectors(spark):
    rows = [("https://x.example/go.php?x=1", True), ("https://x.example/a?url=https://b.example", True), ("https://x.example/a?curl=1", False), ("https://x.example/going/on", False), ("ftp://x.example/go.php", False), (None, False)]
    df = D.with_link(spark.createDataFrame(rows, "url string, want boolean"), "url")
    assert df.where(D.is_redirector() != F.col("want")).count() == 0


@pytest.mark.parametrize("html, base", [(None, "https://x.example/"), ("", "https://x.example/"), ("<a href='/rss'>x</a>", None), ("<a href='/rss'>x</a>", "nowhere"), ("<a href='http://[bad'>next</a>", "https://x.example/")])
def test_no_relations(html, base):
    assert R.relations(html, base) == []


def test_relations(spark):
    html = "<link rel='alternate' type='application/atom+xml' href='a.xml'><a href='/rss'>r</a><a href='/rss'>r</a><a aria-label='Page 3' href='/l'>3</a><a href='#x'>next</a><a href='/page/7'>7</a>"
    want = [("declared_feed", "https://x.example/s/a.xml"), ("anchor_feed", "https://x.example/rss"), ("next_page", "https://x.example/l"), ("next_page", "https://x.example/page/7")]
    assert R.relations(html, "https://x.example/s/") == want
    assert R.relations(html * 2_000, "https://x.example/s/") == want
    df = spark.createDataFrame([(1, html, "https://x.example/s/", "clash"), (None, None, None, None)], "id long, html string, base string, kind string")
    assert [(r.id, r.ord, r.kind) for r in R.page_relations(df, "id", "html", "base").collect()] == [(1, i, k) for i, (k, _) in enumerate(want)]
    assert R.page_relations(df.limit(0), "id", "html", "base").count() == 0


def test_headers(spark):
    df = spark.createDataFrame([(None,), ("",), ("nonsense; rel=alternate",), ('<a>; type=application/json; rel="x alternate"',)], "h string")
    assert [[(x.target, x.type) for x in r.f] for r in df.select(R.header_feeds(F.col("h")).alias("f")).collect()] == [[], [], [], [("a", "application/json")]]
