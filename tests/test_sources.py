from newsmill.functions import text as T
from newsmill.functions import urls as U
from newsmill.operators import url_policy as P
from newsmill.sources import feeds, pages, robots
from pyspark.sql import functions as F

RSS = """<rss><channel><title>no item</title><ITEM><title><![CDATA[A &amp; B]]></title><link> https://a.example/1 </link><pubDate>Mon</pubDate>
<description>&lt;p&gt;x&lt;/p&gt;</description><category>one</category><category><![CDATA[two]]></category><category> </category></ITEM><item><guid isPermaLink="false">7</guid></item></channel></rss>"""
ATOM = """<feed><entry><title type="html">T</title><link rel="alternate" href='https://a.example/2'/><id>tag:1</id><updated></updated><published>P</published><content>C</content><category term="k"/></entry></feed>"""
JSON = '{"version": "https://jsonfeed.org/version/1", "items": [{"title": "J", "url": "https://a.example/3", "tags": ["t", ""]}]}'


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, JSON), (4, "<html>"), (5, ""), (6, None), (7, RSS + ATOM)], "id long, body string")
    got = [(r.id, r.format, r.ord, r.title, r.link, r.guid, r.pub_date, r.description, list(r.categories)) for r in feeds.any_items(df, "body").orderBy("id", "ord").collect()]
    rss = ("rss", 0, "A & B", "https://a.example/1", "", "Mon", "<p>x</p>", ["one", "two"])
    assert got[0] == (1, *rss)
    assert got[1] == (1, "rss", 1, "", "", "7", "", "", [])
    assert got[2] == (2, "atom", 0, "T", "https://a.example/2", "tag:1", "P", "C", ["k"])
    assert got[3] == (3, "json", 0, "J", "https://a.example/3", "https://a.example/3", "", "", ["t"])
    assert [g[0] for g in got[4:]] == [7, 7]  # items before entries


def test_sitemap(spark):
    body = "<urlset><url><loc> https://a.example/1 </loc><lastmod>2023</lastmod><news:publication_date>2024</news:publication_date></url><url><loc>https://a.example/1</loc></url><url><lastmod>x</lastmod></url></urlset>"
    df = spark.createDataFrame([(1, body), (2, "<loc>https://a.example/9</loc>"), (3, None)], "id long, body string")
    got = sorted((r.id, r.ord, r.loc, r.lastmod) for r in feeds.sitemap_entries(df, "body").collect())
    assert got == [(1, 0, "https://a.example/1", "2024"), (2, 0, "https://a.example/9", None)]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a/\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: mill\nDisallow: /only\n"
    rules = robots.robots_rules(spark.createDataFrame([("d", body), ("e", None)], "domain string, body string"), "domain", "body")
    paths = ["/a/x", "/a/b/c", "/x.pdf", "/x.pdf?y", "/only/1", "/"]
    urls = spark.createDataFrame([("d", p) for p in paths] + [("e", "/a/x")], "domain string, path string")
    ok = {(r.domain, r.path): r.allowed for r in robots.robots_allowed(urls, rules, "other/1").collect()}
    assert ok == {("d", "/a/x"): False, ("d", "/a/b/c"): True, ("d", "/x.pdf"): False, ("d", "/x.pdf?y"): True, ("d", "/only/1"): True, ("d", "/"): True, ("e", "/a/x"): True}
    mine = {r.path: r.allowed for r in robots.robots_allowed(urls, rules, "Mill/2").where("domain = 'd'").collect()}
    assert mine["/only/1"] is False and mine["/a/x"] is True


def test_pages():
    p = pages.read_page('<html><title>t</title><nav>menu<p>x</nav><article><h1>Head</h1><p>One <a href="/l">two</a><p>Three<br>four<script>"</p>"</script></article><footer>f</footer>')
    assert [(t, a) for t, a, _ in p.paragraphs] == [("Head", True), ("One two", True), ("Three", True), ("four", True)]
    assert p.links == [("/l", "two")] and p.meta["h1"] == "Head"
    assert pages.read_page(None).paragraphs == [] and pages.read_page("").paragraphs == []


def test_urls(spark):
    rows = [("HTTP://WWW.A.example:80/x//?b=2&utm_source=q&a=1#f", "http://www.a.example/x?b=2&a=1", "https://www.a.example/x?a=1&b=2"), ("https://u:p@a.example/", "https://a.example/", None), ("ftp://a.example/x", None, None), ("nothing", None, None), ("", None, None), (None, None, None)]
    df = U.with_url(spark.createDataFrame([(r[0],) for r in rows], "link string"), "link").select(U.clean_url(), U.canonical_identity())
    assert [tuple(r) for r in df.collect()] == [(r[1], r[2]) for r in rows]


def test_url_policy(spark):
    cases = {"/": "utility_path", "/tag/x": "listing_or_topic_path", "/2023/01/02/a-b-c-d-e-f.html": None, "/video/2023/01/02/one-two-three-four-five": None, "/login": "account_or_private_path", "/a": None, "/tag/2023/01/02/news/some-long-slug-of-words.html": None}
    df = P.judged(spark.createDataFrame([(k, "") for k in cases], "p string, q string"), "p", "q")
    assert {r.p: r.reason for r in df.collect()} == cases


def test_mojibake():
    assert T.repair_mojibake_text("Ã©tÃ©") == "été" and T.repair_mojibake_text("ÃƒÃ‚Â©") is not None
    assert T.repair_mojibake_text("déjà vu Â") == "déjà vu Â" and T.repair_mojibake_text(None) is None and T.repair_mojibake_text("") == ""
