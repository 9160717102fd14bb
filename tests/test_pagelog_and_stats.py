import pytest
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.functions import simhash
from gristmill.operators import components, near, stats
from gristmill.sources import pagelog


def test_log_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [("http://www.h.example/a/1?utm_source=1", "some text", -1, 1.5), ("http://h.example/a/2", None, 7, 2.0), ("nonsense", "x", 1, 1.0)],
        "url string, text string, simhash bigint, fetched_at double",
    )
    pagelog.write(pages, str(tmp_path / "log"))
    (tmp_path / "log" / "host=h.example" / "z.json").write_text('\n{"fetch_url": 1\nnot json\n{"text": "no url"}\n')
    log = pagelog.read(spark, str(tmp_path / "log"))
    back = {r.fetch_url: r for r in log.where("fetch_url is not null").collect()}
    assert set(back) == {"http://www.h.example/a/1", "http://h.example/a/2"}
    assert back["http://www.h.example/a/1"].simhash == 2**64 - 1 and back["http://h.example/a/2"].text == ""
    events = pagelog.replay(log)
    assert {(r.host, r.pattern, r.simhash) for r in events.collect()} == {("h.example", "/a/{NUMBER}", -1), ("h.example", "/a/{NUMBER}", 7)}
    assert pagelog.replayed_rows(log) == 2


def test_log_order_is_that_of_files_and_lines(spark, tmp_path):
    # Spark packs large files first; the order of names must win, also where a file is read in pieces.
    line = '{{"fetch_url": "http://h.example/{}", "text": "{}"}}'
    (tmp_path / "a.jsonl").write_text("\n".join(line.format(f"a{i}", "") for i in range(3)))
    (tmp_path / "b.jsonl").write_text("\n".join(line.format(f"b{i}", "x" * 500) if i % 7 else "" for i in range(400)))
    (tmp_path / "c.jsonl").write_text(line.format("c0", "y" * 9) + "\nbroken\n" + line.format("c1", ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = pagelog.read(spark, str(tmp_path)).select("seq", "fetch_url").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(400) if i % 7] + ["c0", "c1"]
    assert [r.fetch_url.rsplit("/")[-1] for r in sorted(rows)] == want
    assert len({r.seq for r in rows}) == len(rows) and min(r.seq for r in rows) == 0


def test_replay_fills_what_is_missing(spark):
    log = spark.createDataFrame(
        [(1, "http://h.example/x", None, None, "hello"), (2, "http://h.example/y", [], None, ""), (3, "bad", ["/k"], None, "t"), (4, "http://h.example/z", ["/k"], None, None)],
        "seq bigint, fetch_url string, bucket_keys array<string>, simhash decimal(20,0), text string",
    )
    got = {r.seq: (r.pattern, r.simhash, r.n_features) for r in pagelog.replay(log).collect()}
    assert got == {1: ("/x", simhash.simhash_of(["hello"]), 1), 2: ("/y", None, 0), 4: ("/k", None, 0)}


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://www.h.example/a/", "the cat sat"), (2, "http://h.example/a?x=1", "later copy"), (3, "http://h.example/b", "dog dog cat"), (4, "bad", "zzz zzz"),
        (5, None, "zzz"), (6, "http://g.example/", None),
    ]
    return spark.createDataFrame(rows, "seq bigint, fetch_url string, text string")


def test_statistics_and_ties(spark, pages):
    first = stats.first_pages(pages)
    assert {r.seq for r in first.collect()} == {1, 3, 6}
    assert stats.longest_page(first).first().url == "http://www.h.example/a/"
    assert [r.url for r in stats.largest_pages(first, 2).orderBy("rank").collect()] == ["http://www.h.example/a/", "http://h.example/b"]
    stop = spark.createDataFrame([("the",), (" Cat ",), (None,)], "word string")
    assert [(r.word, r.n) for r in stats.top_words(stats.word_frequencies(first, stop)).orderBy("rank").collect()] == [("cat", 2), ("dog", 2), ("sat", 1)]
    report = stats.report(first, stop)
    assert report.startswith("Unique pages: 3\n") and "Subdomains (2):\n  g.example, 1\n  h.example, 2\n" in report


def test_statistics_of_nothing(spark, pages):
    first = stats.first_pages(pages.limit(0))
    stop = spark.createDataFrame([], "word string")
    assert stats.longest_page(first).count() == 0 and "(none)" in stats.report(first, stop)


def test_tables_of_keys_are_never_broadcast(spark):
    """Their size is underestimated, as a value has 16 keys, so a threshold wouldn't hold them off the driver."""
    df = spark.range(50).selectExpr("id as n", "xxhash64(id) as simhash")
    for found in (near.near_values(df), near.search(df, df)):
        found.collect()
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [block#" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)


def test_near_values_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b for b in base} | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for b in base for _ in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] * 2 + [(None,)], "simhash bigint")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = near.near_values(df)
    assert {(r.value_a, r.value_b) for r in got.collect()} == want and want
    assert near.near_values(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r.id, r.component) for r in got.collect()} == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in range(100, 160)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_config(tmp_path):
    ini = tmp_path / "c.ini"
    ini.write_text("[IDENTIFICATION]\nUSERAGENT = me, 1\n[CONNECTION]\nHOST=h\nPORT=1\n[CRAWLER]\nSEEDURL=a,b\nPOLITENESS=0.5\n[LOCAL PROPERTIES]\nSAVE=s\nTHREADCOUNT=1\n")
    assert conf.CrawlConfig.read(str(ini)).seed_urls == ["a", "b"]
    for agent in ("DEFAULT AGENT", "bad!", ""):
        with pytest.raises(ValueError):
            conf.CrawlConfig(agent, "h", 1)


def test_extra_columns_do_no_harm(spark, pages):
    wide = pages.withColumn("n", F.lit(1)).withColumn("host", F.lit("x")).withColumn("url", F.lit("y"))
    assert stats.first_pages(wide).count() == 3
