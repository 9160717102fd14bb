from pyspark.sql import functions as F

from gristmill.functions import html, simhash, text

PAGE = '<html><body><nav>n</nav><p>A <b>b</b><!-- c --> d &amp; e</p><div role="search">s</div></body></html>'


def test_visible_text():
    assert html.visible_text(html.parsed(PAGE)) == "A\nb\nd & e"
    assert html.visible_text(html.parsed("<p>a<p>b<ul><li>c<li>d</ul>")) == "a\nb\nc\nd"
    assert html.visible_text(html.parsed("<body>" + "<div>" * 5000 + "deep")) == "deep"
    assert html.visible_text(html.parsed("<script>x</p></script>y<style>z</style>")) == "y"
    assert not html.looks_like_html("plain <p>x</p>") and not html.looks_like_html(None)


def test_links_in_order():
    page = (
        '<html><head><base href="/b/"><link rel="canonical" href="/c"></head><body><iframe src="f"></iframe>'
        '<a href=" x ">1</a><area href="y"><a>none</a><a href="http://[bad">2</a></body></html>'
    )
    assert html.link_candidates(html.parsed(page), "http://h.example/p/q") == [
        "http://h.example/b/x", "http://h.example/b/y", "http://h.example/b/f", "http://h.example/c",
    ]


def test_page_udf_handles_odd_content(spark):
    rows = [(None, "http://h.example/"), (bytearray(b""), None), (bytearray(b"\xff\xfe<html><p>caf\xe9"), "http://h.example/"), (bytearray(PAGE.encode()), "http://h.example/")]
    df = spark.createDataFrame(rows, "c binary, u string").select(html.page("c", "u").alias("p"))
    assert [r.p.text for r in df.collect()] == ["", "", "ÿþ\ncafé", "A\nb\nd & e"]


def test_simhash_values(spark):
    df = spark.createDataFrame([("",), (None,), ("hello",), ("hello hello",), ("b a",), ("a b",)], "t string")
    got = [r[0] for r in df.select(simhash.text_simhash("t")).collect()]
    assert got[:4] == [0, 0, 8514701317032132957, 8514701317032132957] and got[4] == got[5]
    assert simhash.simhash_of(["a", "b"]) & (2**64 - 1) == simhash.feature_hash("a") & simhash.feature_hash("b")


def test_distance_and_unsigned(spark):
    df = spark.range(1).select(simhash.distance(F.lit(-1).cast("bigint"), F.lit(7).cast("bigint")).alias("d"))
    assert df.first().d == 61
    df = spark.createDataFrame([(-1,), (0,), (2**63 - 1,), (-(2**63),), (None,)], "v bigint")
    back = df.select("v", simhash.to_unsigned(F.col("v")).alias("u")).select("v", "u", simhash.from_unsigned(F.col("u")).alias("w"))
    assert back.where("not (v <=> w)").count() == 0 and back.where("v = -1").first().u == 2**64 - 1


def test_tokens(spark):
    df = spark.createDataFrame([("Don't für 3x",), ("Don't für_x 3.14",), (None,)], "t string")
    got = df.select(text.words(F.col("t")).alias("w"), text.features(F.col("t")).alias("f")).collect()
    assert got[0].w == ["don't", "f", "r", "x"] and got[1].f == ["don", "t", "für_x", "3", "14"] and got[2].w == []
