import random

import pytest

from gristmill import conf
from gristmill.operators import frontier, traps
from gristmill.streaming.traps import PatternState, run_to_end

SMALL = conf.TrapThresholds(min_pages=4, max_urls=15, near_dup_trigger=4, low_value_trigger=5, min_requests=6, subtree_trigger=3)
EVENT = "host string, pattern string, seq bigint, status int, simhash bigint, n_features int"


def one_by_one(events, limits):
    """Bans of events taken one by one, and of the subtrees above them."""
    patterns, bans, counts, subtrees = {}, set(), {}, set()
    for host, pattern, seq, status, h, n in sorted(events, key=lambda e: e[2]):
        reason = patterns.setdefault((host, pattern), PatternState()).take(status, h, n or 0, limits)
        if reason:
            bans.add((host, pattern, seq, reason))
            parts = pattern.split("/")
            for i in range(1, len(parts)):
                above = "/".join(parts[:i])
                if above.count("/") >= limits.subtree_min_depth:
                    counts[host, above] = counts.get((host, above), 0) + 1
                    if counts[host, above] == limits.subtree_trigger:
                        subtrees.add((host, above, seq))
    return bans, subtrees


def random_events(seed, n=700):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(3)]
    out = []
    for seq in range(1, n + 1):
        pattern = f"/a/b/{rng.choice('xyzuv')}" if rng.random() < 0.8 else f"/c/{rng.choice('pq')}"
        status = rng.choice([200, 200, 404, 404, 404, 500, 601, None])
        page = rng.random() < 0.6
        h = (rng.choice(base) ^ (1 << rng.randrange(40)) if rng.random() < 0.5 else rng.getrandbits(64) - (1 << 63)) if page else None
        out.append((rng.choice(["h1", "h2"]), pattern, seq, status, h, rng.choice([3, 80]) if page else None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sets_equal_one_by_one(spark, seed):
    events = random_events(seed)
    bans, subtrees = one_by_one(events, SMALL)
    df = spark.createDataFrame(events + events[:20], EVENT).repartition(3)
    got = traps.pattern_bans(df, SMALL)
    assert {tuple(r) for r in got.collect()} == bans and bans
    assert {tuple(r) for r in traps.subtree_bans(got, SMALL).collect()} == subtrees


def test_stream_equals_one_by_one(spark, tmp_path):
    events = random_events(9)
    path = str(tmp_path / "trap_events.parquet")
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(path)
    assert {tuple(r) for r in run_to_end(spark, path, SMALL).collect()} == one_by_one(events, SMALL)[0]


def rows(n, pattern="/p", status=200, h=None, words=100, start=1):
    return [("h", pattern, start + i, status, h(i) if h else None, words if h else None) for i in range(n)]


def banned(spark, events):
    return [tuple(r) for r in traps.pattern_bans(spark.createDataFrame(events, EVENT)).collect()]


def test_edges_of_the_thresholds(spark):
    far = lambda i: (i * 0x9E3779B97F4A7C15) % (1 << 63)
    assert banned(spark, rows(21, h=lambda i: 5)) == []
    assert banned(spark, rows(22, h=lambda i: 5)) == [("h", "/p", 22, "near_dup")]
    assert banned(spark, rows(20, h=far, words=49)) == []
    assert banned(spark, rows(21, h=far, words=49)) == [("h", "/p", 21, "low_value")]
    assert banned(spark, rows(30, h=far, words=50)) == []
    assert banned(spark, rows(20, status=404)) == []
    assert banned(spark, rows(21, status=404)) == [("h", "/p", 21, "error_rate")]
    assert banned(spark, rows(5) + rows(20, status=404, start=6)) == []


def test_subtrees_disable_what_lies_below(spark):
    bans = spark.createDataFrame([("h", "/a/b/x", 1, "r"), ("h", "/a/b/y", 2, "r")], "host string, pattern string, seq bigint, reason string")
    assert traps.subtree_bans(bans).count() == 0
    bans = bans.union(spark.createDataFrame([("h", "/a/b/z", 3, "r")], bans.schema))
    subtrees = traps.subtree_bans(bans)
    assert [tuple(r) for r in subtrees.collect()] == [("h", "/a/b", 3)]
    asked = spark.createDataFrame([("h", p) for p in ("/a/b/q", "/a/b", "/a/bc", "/a", "/a/b/x")] + [("g", "/a/b")], "host string, pattern string")
    assert {tuple(r) for r in traps.enabled_patterns(asked, bans, subtrees).collect()} == {("h", "/a/bc"), ("h", "/a"), ("g", "/a/b")}


def test_empty_and_null_events(spark):
    empty = spark.createDataFrame([], EVENT)
    assert traps.pattern_bans(empty).count() == 0
    nulls = spark.createDataFrame([(None, "/p", 1, 404, 1, 1), ("h", None, 2, 404, 1, 1), ("h", "/p", None, 404, 1, 1), ("h", "/p", 3, None, None, None)], EVENT)
    assert traps.pattern_bans(nulls).count() == 0 and traps.running_counts(nulls).count() == 1


def test_prefix_sums_across_blocks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("k", i, i % 3) for i in range(1, 101)], "key string, seq bigint, x int")
    got = traps.prefix_sums(df, ["key"], "seq", {"s": F.col("x")}, block=7).orderBy("seq").collect()
    total = 0
    for r in got:
        total += r.x
        assert r.s == total


def test_frontier_steps(spark):
    schema = "url_hash string, url string, completed boolean, seq bigint"
    saved = spark.createDataFrame(
        [("", "http://a.ics.university.example/1", False, 1), ("", "https://a.ics.university.example/1", True, 5), ("", "http://a.ics.university.example/2", None, 2), ("", "http://b.ics.university.example/a/b/q", False, 3), ("", None, False, 4)], schema
    )
    state = frontier.state(saved)
    assert {(r.url, r.completed) for r in state.collect()} == {("http://a.ics.university.example/1", True), ("http://a.ics.university.example/2", False), ("http://b.ics.university.example/a/b/q", False)}
    bans = spark.createDataFrame([], "host string, pattern string, seq bigint, reason string")
    subtrees = spark.createDataFrame([("b.ics.university.example", "/a/b", 9)], "host string, subtree string, seq bigint")
    assert [r.url for r in frontier.dequeue(state, bans, subtrees, 5).collect()] == ["http://a.ics.university.example/2"]
    fresh = frontier.enqueue(state, spark.createDataFrame([("https://a.ics.university.example/2", 7), ("http://a.ics.university.example/3", 8)], "url string, seq bigint"))
    assert [r.url for r in fresh.collect()] == ["http://a.ics.university.example/3"]
    done = frontier.complete(state, spark.createDataFrame([("http://a.ics.university.example/2",)], "url string"))
    assert {r.url for r in done.where("not completed").collect()} == {"http://b.ics.university.example/a/b/q"}
    assert [r.url for r in frontier.load(saved, bans, subtrees).collect()] == ["http://a.ics.university.example/2"]


def test_verdicts_in_order(spark):
    bans = spark.createDataFrame([("a.ics.university.example", "/ban", 1, "r")], "host string, pattern string, seq bigint, reason string")
    subtrees = spark.createDataFrame([], "host string, subtree string, seq bigint")
    found = [("http://a.ics.university.example/x", 1), ("https://www.a.ics.university.example/x/", 2), ("http://a.ics.university.example/ban", 3), ("http://a.ics.university.example/f.PDF", 4), ("http://math.university.example/", 5), ("ftp://a.ics.university.example/y", 6), ("nonsense", 7), (None, 8)]
    got = frontier.verdicts(spark.createDataFrame(found, "url string, seq bigint"), bans, subtrees)
    assert {r.seq: r.verdict for r in got.collect()} == {1: "accept", 2: "seen", 3: "banned-bucket", 4: "bad-extension", 5: "out-of-scope", 6: "bad-scheme", 7: "out-of-scope", 8: "out-of-scope"}
