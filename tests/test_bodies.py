import pytest
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.operators import access, bodies
from newsmill.sources import containers as C
from newsmill.sources import pages
from newsmill.sources import structured as S
from newsmill.sources.dom import tree

P = ["The harbour board of the town decided on Monday that the old grain store at the quay will be sold, said its chair, after a debate of %d hours." % i for i in range(1, 9)]


def _html(inner, before="", after=""):
    return f"<html><body><nav><p>Home of all the news that there is today</p></nav>{before}<article class=story>{inner}</article>{after}<footer><p>About us and all our many other papers</p></footer></body></html>"


def test_tree():
    t = tree("<div>a<p>one<p>two<br>three<ul><li>x<li>y</ul></div><script>var a = '<p>no</p>'</script>tail</span>")
    assert [n.tag for n in t.elements()] == ["div", "p", "p", "br", "ul", "li", "li", "script"]
    assert t.text() == "aonetwo\nthreexytail"
    assert tree(None).text() == "" and tree("").children == [] and tree("<<<p").text() is not None


def test_paragraphs_end_at_what_follows_an_article():
    html = _html("".join(f"<p>{p}</p>" for p in P[:4]) + "<p>short</p><h3>Related articles</h3>" + "".join(f"<p>{p}</p>" for p in P[4:]))
    (got,) = [c for c in C.containers(html) if c[0] == "article"]
    assert got[1] == P[:4]
    beside = _html(f"<div class=byline><p>{P[0]}</p></div><div><p>{P[1]}</p><p>{P[2]}</p><p>{P[3]}</p><p>{P[1]}</p></div><div class=newsletter-box><p>{P[4]}</p></div><p>{P[5]}</p>")
    assert C.containers(beside)[0][1] == P[1:4]
    divs = _html("".join(f"<div>{p}</div>" for p in P[:3]))
    assert C.containers(divs)[0][1] == P[:3]
    assert C.containers("<article><p>too short</p></article>") == [] and C.containers(None) == []
    assert C.containers("<div>" * 3000 + "x")[:1] == []


def _chosen(spark, *htmls, excerpt=None):
    df = spark.createDataFrame([(i, h, excerpt, "clash") for i, h in enumerate(htmls)], "id long, html string, excerpt string, score string")
    t = C.page_containers(df, "id", "html").join(df.select("id", "excerpt"), "id")
    r = bodies.ranked(t, "id")
    return r, {x.id: x for x in bodies.chosen(r, "id").collect()}


def test_choice(spark):
    full = "".join(f"<p>{p}</p>" for p in P)
    teaser = f"<div class=teaser><p>{P[0]}</p><p>{P[1]}</p></div>"
    links = "<section>" + "".join(f"<p><a href=/x>{p}</a></p>" for p in P) + "</section>"
    r, got = _chosen(spark, _html(full, teaser, links), _html("<p>" + P[0] + "</p>"), None, "", _html(full))
    assert got[0].body == "\n\n".join(P) and got[0].selector == "article" and got[0].tried == []
    assert got[1].body is None and got[1].tried == ["not_usable"]
    assert set(got) == {0, 1, 4}
    scores = {(x.id, x.selector): x.score for x in r.collect()}
    # Eight paragraphs, text between 800 and 1200 characters and more, mean length, semantic container.
    assert 800 <= sum(map(len, P)) < 1200 and scores[0, "article"] == 35 + 12 + 10 + 15
    assert scores[0, "div/section"] < scores[0, "article"]


def test_preference(spark):
    rows = [(None, 0, "x", 1, True), ("x" * 400, 2, "y" * 800, 1, True), ("x" * 900, 3, "y" * 1000, 9, False), ("x" * 900, 3, "y" * 1100, 6, True), ("x" * 900, 3, "y" * 1400, 3, True), ("x" * 900, 3, "y" * 1400, 2, False), ("x", 1, None, 0, False), ("x" * 600, 1, "", 0, False)]
    df = spark.createDataFrame(rows, "a string, na int, b string, nb int, want boolean")
    assert [r[0] for r in df.select(bodies.prefers(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))).collect()] == [r[4] for r in rows]


CALL, LONG = "Subscribe to continue reading this story", "One sentence here. " * 40
ACCESS = [  # status, raw, usable, truncated, gate, calls, declared, matched, class, confidence
    (401, LONG, True, False, False, None, False, False, "HTTP_ACCESS_BLOCKED", "HIGH"),
    (403, LONG, True, False, False, None, True, True, "HTTP_ACCESS_BLOCKED", "HIGH"),
    (402, LONG, True, False, False, None, False, False, "ACCESSIBLE", "HIGH"),
    (200, "Checking your browser", False, False, False, None, False, False, "INTERSTITIAL_OR_CHALLENGE", "LOW"),
    (200, "Checking your browser. Just a moment", False, False, False, CALL, False, False, "INTERSTITIAL_OR_CHALLENGE", "MEDIUM"),
    (200, "Access denied", False, False, False, CALL, False, False, "HTTP_ACCESS_BLOCKED", "MEDIUM"),
    (200, CALL, False, False, False, CALL, True, True, "PAYWALL_BLOCKED", "MEDIUM"),
    (200, CALL, False, True, False, CALL, False, False, "PAYWALL_BLOCKED", "HIGH"),
    (200, LONG, True, False, False, None, True, False, "METERED_OR_DECLARED", "LOW"),
    (200, LONG, True, False, False, None, True, True, "METERED_OR_DECLARED", "MEDIUM"),
    (200, LONG, True, False, True, None, True, False, "METERED_OR_DECLARED", "HIGH"),
    (200, LONG, True, False, False, CALL, False, False, "METERED_OR_DECLARED", "MEDIUM"),
    (200, LONG, True, False, True, CALL, False, False, "METERED_OR_DECLARED", "HIGH"),
    (200, LONG, True, False, True, None, False, False, "METERED_OR_DECLARED", "LOW"),
    (200, LONG + CALL + " paywall", True, False, False, None, False, False, "ACCESSIBLE", "HIGH"),
    (200, "Ad blocker detected", False, False, True, None, False, False, "INTERSTITIAL_OR_CHALLENGE", "LOW"),
    (200, "x", False, False, True, None, False, False, "PAYWALL_BLOCKED", "LOW"),
    (200, "Behind a paywall, a premium subscription", False, False, False, None, False, False, "UNKNOWN", "LOW"),
    (None, None, None, None, None, None, None, None, "UNKNOWN", "LOW"),
]


def test_access_decision(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ACCESS)], "i int, status int, raw string, usable boolean, truncated boolean, gate boolean, calls string, declared boolean, matched boolean, want string, sure string")
    names = ["status", "raw", "usable", "truncated", "gate", "calls", "declared", "matched"]
    got = {r.i: r.a for r in df.select("i", access.access_decision(*map(F.col, names)).alias("a")).collect()}
    assert [(got[i]["class"], got[i].confidence) for i in range(len(ACCESS))] == [r[8:] for r in ACCESS]
    assert got[17].evidence == ["partial_body_without_evidence", "topic_signals"] and got[7].evidence == ["article_scoped_cta", "body_truncation_detected"]


def test_declared_walls():
    free = {"@type": ["WebPage", "NewsArticle"], "isAccessibleForFree": False}
    part = {"@type": "Article", "hasPart": [{"@type": ["PaywalledContent"]}, "x", None]}
    here = "https://a.example/News/1?x=1#y"
    assert S.wall_signals([{**free, "url": "/News/1/"}], here) == [("isAccessibleForFree:false", "matched")]
    assert S.wall_signals([{**free, "url": "/news/1"}], here) == []
    assert S.wall_signals([free], here) == [("isAccessibleForFree:false", "unstated")] and S.wall_signals([free], None) == [("isAccessibleForFree:false", "unstated")]
    assert S.wall_signals([free, part], here) == [] and S.wall_signals([free], "not an address") == []
    assert S.wall_signals([free, {"@graph": [{**part, "mainEntityOfPage": {"@id": here}}]}], here) == [("PaywalledContent", "matched")]
    assert S.wall_signals([{"@type": "Article", "@id": here, "about": free}], here) == [("isAccessibleForFree:false", "matched")]
    assert S.wall_signals([{"isAccessibleForFree": False}, {"@type": "WebPage", "isAccessibleForFree": False}, None, 3, "x"], here) == []
    assert S.wall_signals([{**free, "isAccessibleForFree": "False"}], here) == [] and S.wall_signals([], here) == []


def test_publishable(spark):
    rows = [("t", "u", "x" * 500, True), ("t", "u", " " * 9 + "x" * 499, False), (" ", "u", "x" * 500, False), ("t", None, "x" * 500, False), ("t", "u", "Enable JavaScript and enable cookies " + "x" * 500, False), ("t", "u", "Enable JavaScript " + "x" * 500, True), ("t", "u", None, False)]
    df = spark.createDataFrame(rows, "t string, u string, b string, want boolean")
    assert [r[0] for r in df.select(access.is_publishable(F.col("t"), F.col("u"), F.col("b"))).collect()] == [r[3] for r in rows]


@pytest.mark.parametrize(
    "text, value, flags",
    [
        (" plain ", "plain", []),
        ("<![CDATA[a]]>", "a", ["cdata_stripped"]),
        ("a &amp; b", "a & b", ["entity_decoded"]),
        ("itâ€™s â‚¬5 – cafÃ©", "it’s €5 – café", ["mojibake_repaired", "suspected_mojibake"]),
        ("Ã‰ire Â£5", "Éire £5", ["mojibake_repaired", "suspected_mojibake"]),
        ("bad � char", "bad � char", ["suspected_mojibake"]),
        ("", "", []),
    ],
)
def test_normalised_text(spark, text, value, flags):
    r = spark.createDataFrame([(text,), (None,)], "t string").select(T.normalize_text_detailed(F.col("t")).alias("n")).collect()
    assert (r[0].n.value, r[0].n.flags, r[0].n.changed) == (value, flags, value != text.strip()) and r[1].n is None


def test_dates_of_pages(spark):
    rows = [('<meta name="date" content="d">', "https://a.example/2024/02/03/x", "d", "meta[name=date]"), ('<meta property="og:updated_time" content="u">', "https://a.example/2024/02/03/x", "2024-02-03", "url_date"), ('<meta property="og:updated_time" content="u">', "https://a.example/x", "u", "og:updated_time"), ("<p>", "https://a.example/x", None, None), (None, None, None, None)]
    got = spark.createDataFrame(rows, "h string, u string, r string, s string").select(pages.page_date(F.col("h"), F.col("u")).alias("d")).collect()
    assert [(x.d.raw, x.d.source) if x.d else (None, None) for x in got] == [r[2:] for r in rows]
