import datetime as dt
import json

from pyspark.sql import functions as F

from newsmill.functions import urls as U
from newsmill.functions import values as V
from newsmill.operators import discovery as D
from newsmill.operators import url_policy as P
from newsmill.sources import feeds, sitekind


def test_bounded_numbers(spark):
    rows = [("7", 7), (" 12.9 ", 12), ("-3", 1), ("999", 99), ("", 5), (None, 5), ("x", 5), ("1e3", 5), ("NaN", 5)]
    df = spark.createDataFrame(rows, "v string, want int")
    assert [r[0] for r in df.select(V.bounded_number(F.col("v"), 5, 1, 99)).collect()] == [r[1] for r in rows]


def test_ranges(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(t(1), t(5), t(10)), (None, None, t(10)), (t(8), t(20), t(10)), (t(9), t(3), t(10)), (dt.datetime(2020, 1, 1), t(5), t(10))]
    got = [r.r for r in spark.createDataFrame(rows, "a timestamp, b timestamp, n timestamp").select(V.clamped_range(F.col("a"), F.col("b"), F.col("n")).alias("r")).collect()]
    assert [(g.date_from, g.date_to, g.days) for g in got] == [(t(1), t(5), 4), (t(3), t(10), 7), (t(8), t(10), 2), (t(2), t(3), 1), (t(5) - dt.timedelta(90), t(5), 90)]


def test_buckets_and_keys(spark):
    df = spark.createDataFrame([(0,), (99,), (100,), (4999,), (30000,)], "ms int")
    assert [r[0] for r in df.select(V.duration_bucket(F.col("ms"))).collect()] == ["lt_100ms", "lt_100ms", "lt_1s", "lt_5s", "gte_30s"]
    df = spark.createDataFrame([(["a"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(V.has_tag(F.col("t"), ["a", "b"])).collect()] == [True, False, False] and [r[0] for r in df.select(V.has_tag(F.col("t"), [])).collect()] == [True] * 3


def test_posts(spark):
    body = json.dumps([{"link": "https://a/1", "title": {"rendered": " One "}, "date": "d"}, {"link": "https://a/1", "title": "again"}, {"title": "no link"}, {"link": "https://a/2", "title": "Two"}, {"link": "", "title": "x"}])
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, None), (4, "[]")], "id int, body string")
    got = sorted((r.id, r.ord, r.url, r.headline, r.published) for r in feeds.post_candidates(df, "id", "body").collect())
    assert got == [(1, 0, "https://a/1", "One", "d"), (1, 3, "https://a/2", "Two", None)]


def test_kinds_of_sites(spark):
    rows = [("<meta name=generator x><meta name='generator' content='Ghost 5.2'>", None, "/", ["ghost"]), ("<img src=/wp-content/a.png>", None, "/x", ["wordpress", "path-scoped"]), ("", "Drupal", "", ["drupal"]), (None, None, None, [])]
    df = spark.createDataFrame(rows, "h string, p string, u string, want array<string>")
    assert [r[0] for r in df.select(sitekind.made_by(F.col("h"), F.col("p"), F.col("u"))).collect()] == [r[3] for r in rows]
    files = spark.createDataFrame([('{"region": "HU", "lastUpdated": "d", "sourceCount": 2, "domains": ["a", "b"]}',), ("broken",), (None,)], "content string")
    assert sorted(map(tuple, sitekind.region_domains(files, "content").collect())) == [("HU", "d", "a"), ("HU", "d", "b")]


def test_single_articles(spark):
    rows = [("https://a.example/", False), ("https://a.example/2024/01/31/x", True), ("https://a.example/news/123456", True), ("https://a.example/news/12345", False), ("https://a.example/a-b-c-d-e", False), ("https://a.example/a-b-c-d-e-f", True), ("https://a.example/s/" + "x" * 41, True), ("https://a.example/sport/football/", False)]
    df = U.with_url(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string"), "a")
    assert [r[1] for r in sorted(map(tuple, df.select("i", D.is_single_article()).collect()))] == [w for _, w in rows]


def test_short_hosts_are_no_articles(spark):
    df = U.with_url(spark.createDataFrame([("https://ab/path/of-some-long-article-12345",), ("https://abc/path/of-some-long-article-12345",), ("ftp://abc/path",)], "a string"), "a")
    got = {r.a: r.reason for r in P.judged(df.withColumn("p", U.valid_path()), "p", "u_query").collect()}
    assert list(got.values()).count("invalid_url") == 2 and got["https://abc/path/of-some-long-article-12345"] is None
