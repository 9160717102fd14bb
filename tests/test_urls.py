import pytest
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.functions import rules, urls

PATTERNS = [
    ("/", ""), ("", ""), ("/en/98", "/en/{NUMBER}"), ("/en/7/", "/en/{NUMBER}"), ("/en/176.html", "/en/{FILE}"), ("/a/2024-02-30", "/a/{DATE}"),
    ("/a/1-2-24/x", "/a/{DATE}/x"), ("/a/2025-02", "/a/{YEAR_MONTH}"), ("/a/2024.01", "/a/{YEAR_MONTH}"), ("/a/1.5", "/a/{FILE}"),
    ("/2024-13-01", "/2024-13-01"), ("/a/20240115", "/a/{NUMBER}"), ("/wiki/Special:Recent", "/wiki/special/{PAGE}"), ("/A:B:c", "/a/b/{PAGE}"),
    ("/v1.2/X", "/v1.2/x"), ("/a/b.html/", "/a/{FILE}"), ("/A//B", "/a//b"), ("/t/12:30", "/t/12/{PAGE}"), ("/a/" + "x" * 128, "/a/{LARGE}"),
    ("/a/" + "x" * 127, "/a/" + "x" * 127),
]
URLS = [
    ("https://www.H.example.com:8080/A/?utm_source=f&b=2&a=1#t", "https://www.h.example.com/A/?a=1&b=2", "http://h.example.com/A?a=1&b=2"),
    ("http://h.example.com", "http://h.example.com", "http://h.example.com/"),
    ("http://h.example.com/d/?C=N;O=D", "http://h.example.com/d/", "http://h.example.com/d"),
    ("http://h.example.com/d?x=", "http://h.example.com/d", "http://h.example.com/d"),
    ("http://h.example.com/d?q=a+b~*%C3%A9&p=100%25", "http://h.example.com/d?p=100%25&q=a+b~%2A%C3%A9", "http://h.example.com/d?p=100%25&q=a+b~%2A%C3%A9"),
    ("http://h.example.com/?q=50%+off%20now", "http://h.example.com/?q=50%25+off+now", "http://h.example.com/?q=50%25+off+now"),
    ("http://h.example.com/?_class=1&tab_size=4&at_home=x&cjk=1&utm_zzz=1", "http://h.example.com/?_class=1&at_home=x&cjk=1&tab_size=4&utm_zzz=1", "http://h.example.com/?_class=1&at_home=x&cjk=1&tab_size=4&utm_zzz=1"),
    ("http://h.example.com/?UTM_source=1&utm_source=2&do=x&rev=3&action=y", "http://h.example.com/?UTM_source=1", "http://h.example.com/?UTM_source=1"),
    ("http://h.example.com/?x=%zz&y=%4", "http://h.example.com/?x=%25zz&y=%254", "http://h.example.com/?x=%25zz&y=%254"),
    ("http://h.example.com/a b|c", None, None), ("not a url", None, None), ("", None, None), (None, None, None),
]


def test_path_patterns(spark):
    df = spark.createDataFrame(PATTERNS, "path string, want string")
    assert [r for r in df.select("path", "want", urls.path_pattern(F.col("path")).alias("got")).collect() if r.got != r.want] == []


def test_normalized(spark):
    df = spark.createDataFrame(URLS, "url string, fetch string, key string")
    for r in df.select("*", urls.normalized(F.col("url")).alias("n")).collect():
        assert (r.n.fetch_url, r.n.dedup_key) == (r.fetch, r.key), r.url
        if r.fetch is None:
            assert r.n.bucket_keys == [] and r.n.netloc is None


def test_normalising_again_keeps_the_key(spark):
    df = spark.createDataFrame([(u,) for u, f, _ in URLS if f], "url string").select(urls.normalized(F.col("url")).alias("n"))
    again = df.select("n.dedup_key", urls.normalized(F.col("n.fetch_url")).alias("m"))
    assert again.where("dedup_key <> m.dedup_key").count() == 0


def test_own_tracking_list(spark):
    df = spark.createDataFrame([("http://h.example.com/?utm_source=1&z=2",)], "url string")
    assert df.select(urls.normalized(F.col("url"), ["z"])["query"]).first()[0] == "utm_source=1"


@pytest.mark.parametrize(
    ("host", "want"),
    [("a.ics.university.example", True), ("stat.university.example", True), ("university.example", False), ("math.university.example", False), ("ics.university.example.evil.com", False), (None, False), ("", False)],
)
def test_scope(spark, host, want):
    df = spark.createDataFrame([(host,)], "host string")
    assert df.select(rules.host_in_scope(F.col("host"), conf.Scope(domain="university.example"))).first()[0] is want


def test_status_headers_size_extension(spark):
    statuses = {200: True, 301: True, 399: True, 600: True, 602: True, 607: True, 400: False, 404: False, 599: False, 601: False, 608: False, 700: False, None: True}
    df = spark.createDataFrame([(k, v) for k, v in statuses.items()], "s int, want boolean")
    assert df.where(rules.status_ok(F.col("s")) != F.col("want")).count() == 0
    heads = [
        ({"Content-TYPE": "Text/HTML; charset=utf-8"}, True), ({}, False), (None, False), ({"content-type": "application/pdf"}, False),
        ({"content-type": "text/html", "Content-Length": "26214400"}, True), ({"content-type": "text/html", "content-length": "26214401"}, False),
        ({"content-type": "text/html", "content-length": "abc"}, True),
    ]
    df = spark.createDataFrame(heads, "h map<string,string>, want boolean")
    assert df.where(rules.headers_ok(F.col("h")) != F.col("want")).count() == 0
    paths = [("/a.PDF", False), ("/a.tar.gz", False), ("/x.r.txt", False), ("/a.r", True), ("/a.html", True), ("/a", True), (None, True)]
    df = spark.createDataFrame(paths, "p string, want boolean")
    assert df.where(rules.extension_ok(F.col("p")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(None,), (bytearray(b"x"),)], "c binary")
    assert df.where(~rules.size_ok(F.col("c"))).count() == 0


def test_url_hash_ignores_the_scheme(spark):
    import hashlib

    df = spark.createDataFrame([("http://h.example/a/b;p?q#f",), ("https://h.example/a/b;p?q#f",)], "url string")
    want = hashlib.sha256(b"h.example//a/b/p/q/f").hexdigest()
    assert {r[0] for r in df.select(urls.url_hash(F.col("url"))).collect()} == {want}


def test_tracking_list_of_a_file(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("! comment\n$removeparam=zz\n$removeparam=/^x_/\n$removeparam=qq,domain=h.example\n||h.example^$removeparam=rr\nplain\n\n")
    assert conf.tracking_keys(str(path)) == ["zz", "plain"]
