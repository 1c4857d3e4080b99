import json

from newsmill.operators import access
from newsmill.sources import decoding, sinks, structured
from pyspark.sql import functions as F


def test_candidates():
    graph = {"@graph": [{"@type": ["schema:NewsArticle"], "headline": "A", "mainEntityOfPage": {"@id": "/a"}, "author": [{"name": "Jo"}]}, {"@type": "Product", "url": "/p"}]}
    items = {"@type": "ItemList", "itemListElement": [{"item": {"@type": "NewsArticle", "url": "/a", "name": "again"}}, {"url": "/b", "name": "B"}, {"item": {"@type": "Product", "url": "/c"}}, "odd"]}
    state = {"props": {"pageProps": {"deep": {"stories": [{"slug": "/n", "title": "N"}, {"slug": "/none"}, {"title": "no link"}]}}}}
    got = structured.candidates([json.dumps(graph), "{broken", json.dumps(items)], json.dumps(state), "https://x.example/s/")
    assert [(g[0], g[1], g[4]) for g in got] == [("https://x.example/a", "A", "NewsArticle"), ("https://x.example/b", "B", "ItemList"), ("https://x.example/n", "N", "NextData")]
    assert got[0][3] == "Jo"
    assert structured.candidates([], None, None) == [] and structured.candidates(["[" * 5_000], "null", "") == []


def test_bounds():
    deep = {"@type": "Article", "url": "https://x.example/deep"}
    for _ in range(structured.DEPTH + 2):
        deep = {"k": deep}
    assert structured.candidates([json.dumps(deep)], None, "") == []
    many = [{"@type": "Article", "url": f"https://x.example/{i}"} for i in range(50)]
    assert len(structured.candidates([json.dumps(many)], None, "")) == structured.CANDIDATES


def test_access(spark):
    long = "One sentence here. " * 40
    rows = [(200, long + "Subscribe to continue reading."), (200, "Subscribe to continue reading this."), (403, "x"), (200, "Access denied"), (200, "Checking your browser"), (200, None), (None, "")]
    df = spark.createDataFrame(rows, "status int, body string").withColumn("c", access.access_class(F.col("status"), F.col("body")))
    got = [(r.c, r.p) for r in df.withColumn("p", access.is_paywall(F.col("c"))).collect()]
    assert got == [("ACCESSIBLE", False), ("PAYWALL_BLOCKED", True), ("HTTP_ACCESS_BLOCKED", None), ("HTTP_ACCESS_BLOCKED", None), ("INTERSTITIAL_OR_CHALLENGE", None), ("UNKNOWN", None), ("UNKNOWN", None)]


def test_decoding(spark):
    cases = [("é".encode(), None, "é", "utf-8", "default"), ("é".encode("cp1252"), "text/html; charset=ISO-8859-1", "é", "cp1252", "http"), (b"\xef\xbb\xbfx", "text/html; charset=latin-1", "x", "utf-8", "bom"), ('<?xml version="1.0" encoding="windows-1250"?>ő'.encode("cp1250"), None, '<?xml version="1.0" encoding="windows-1250"?>ő', "cp1250", "document"), ("Ã é".encode(), "text/plain; charset=windows-1252", "Ã é", "utf-8", "recovered"), (b"\xff\xfe\xff", "text/plain; charset=utf-8", None, "utf-16-le", "bom"), (b"", None, "", "utf-8", "default")]
    for body, header, text, charset, origin in cases:
        got = decoding.decode(body, header)
        assert (text is None or got[0] == text) and got[1:3] == (charset, origin), (body, got)
    assert decoding.decode(None) == (None, None, None, False) and decoding.decode(b"\xff")[3]
    df = spark.createDataFrame([(1, bytearray("é".encode("cp1252")), "x; charset=windows-1252"), (2, None, None)], "id long, body binary, t string")
    assert [(r.id, r.text) for r in decoding.decoded(df, "id", "body", "t").collect()] == [(1, "é"), (2, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.append_new(rows, path, ["k"]).count() == 3
    assert sinks.append_new(rows.where("k is not null"), path, ["k"], spark.read.parquet(path)).count() == 0
    assert spark.read.parquet(path).count() == 3
    sinks.write_log(rows.withColumn("kind", F.lit("x")), str(tmp_path / "log"), "kind", ["k", "v"], F.lit("OK"))
    assert json.loads(spark.read.parquet(str(tmp_path / "log")).where("payload like '%\"c\"%'").first().payload) == {"k": 2, "v": "c"}
    sinks.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
