from pyspark.sql import functions as F

from newsmill.functions import urls as U

PARTS = [  # address, identity, host
    ("http://host:abc/x", None, None),
    ("http://[::1]/x", "https://[::1]/x", "[::1]"),
    ("https://[2001:DB8::1]:8443/a?b=1", "https://[2001:db8::1]:8443/a?b=1", "[2001:db8::1]"),
    ("https://a.example", "https://a.example/", "a.example"),
    ("https://a.example?x=1", "https://a.example/?x=1", "a.example"),
    ("https://a.example:443/b/#f", "https://a.example/b", "a.example"),
    ("https://user@a.example/b", None, "a.example"),
    ("http://a.example:80x/b", None, None),
    ("http://[::1/x", None, None),
    ("//a.example/b", None, None),
    ("", None, None),
    (None, None, None),
]
IPS = [  # address, blocked
    ("10.0.0.1", True), ("172.16.9.9", True), ("172.32.0.1", False), ("192.168.1.1", True), ("169.254.0.3", True), ("8.8.8.8", False), ("0.0.0.0", True), ("127.9.9.9", True), ("100.64.1.1", True), ("256.1.1.1", True),
    ("::1", True), ("::", True), ("fe80::1", True), ("fc00::1", True), ("fd12:3456::1", True), ("ff02::1", True), ("2001:db8::1", True), ("2606:4700::1111", False), ("[2606:4700::1111]", False),
    ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("::ffff:a00:1", True), ("::ffff:808:808", False), ("1:2:3:4:5:6:7", True), ("1::2::3", True), ("nonsense", True), (None, True),
]


def test_parts(spark):
    df = U.with_url(spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(PARTS)], "id int, a string"), "a")
    got = {r.id: (r.identity, r.u_host) for r in df.select("id", U.canonical_identity().alias("identity"), "u_host").collect()}
    assert [got[i] for i in range(len(PARTS))] == [(b, c) for _, b, c in PARTS]


def test_blocked_addresses(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(IPS)], "id int, a string")
    got = {r.id: r.blocked for r in df.select("id", U.is_blocked_ip(F.col("a")).alias("blocked")).collect()}
    assert [(IPS[i][0], got[i]) for i in range(len(IPS))] == IPS


def test_public_hosts(spark):
    df = spark.createDataFrame([("news.example",), ("localhost",), ("10.1.1.1",), ("[::1]",), ("[2606:4700::1]",), ("1.2.3",)], "h string")
    assert [r[0] for r in df.select(U.is_public_host(F.col("h"))).collect()] == [True, False, False, False, True, False]
