import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import mixing, packing
from gristmill.llm.tokens import encoder, token_counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_histogram_is_packed_whole(counts):
    patterns = packing.pack_histogram(counts, 64)
    held = {}
    for pattern, n in patterns:
        assert n > 0 and sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            held[k] = held.get(k, 0) + v * n
    assert held == counts


def test_pack(spark):
    encode = encoder().encode_ordinary
    texts = ["word " * n for n in (1, 5, 40, 100, 260, 5, 5)] + [None, "", "<|endoftext|>"]
    rows = [(i, t, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    caps = spark.createDataFrame([("a", 64), ("b", 200), ("bad", 0), ("none", None), (None, 9)], "pack_name string, capacity_tokens int")
    got = packing.pack(df, caps).collect()
    room = {}
    for r in got:
        room[r.pack_name, r.container_id] = room.get((r.pack_name, r.container_id), 0) + r.n_tokens
    assert all(v <= {"a": 64, "b": 200}[k[0]] for k, v in room.items())
    for name, cap in (("a", 64), ("b", 200)):
        for i, t in enumerate(texts):
            n = len(encode(t)) if t else 0
            pieces = sorted((r.piece_no, r.n_tokens) for r in got if r.pack_name == name and r.doc_id == i)
            assert sum(p[1] for p in pieces) == n and len(pieces) == -(-n // cap)
    report = {r.pack_name: r.n_containers for r in packing.pack_report(packing.pack(df, caps), caps).collect()}
    assert set(report) == {"a", "b"}
    assert packing.pack(df.limit(0), caps).count() == 0 and packing.pack(df, caps.limit(0)).count() == 0


def test_hot_length_keeps_ranks_apart(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(500)] + [(7, "one two three")], "doc_id bigint, text string")
    caps = spark.createDataFrame([("a", 10)], "pack_name string, capacity_tokens int")
    per = packing.pack(df, caps, window=20).groupBy("container_id").sum("n_tokens").collect()
    assert sum(r[1] for r in per) == 1503 and max(r[1] for r in per) <= 10 and len(per) == 167


def test_full_pieces_of_one_text_are_spread(spark):
    df = spark.createDataFrame([(1, "word " * 3000)] + [(i, "a b c d") for i in range(2, 50)], "doc_id bigint, text string")
    caps = spark.createDataFrame([("a", 8)], "pack_name string, capacity_tokens int")
    got = packing.pack(df, caps, window=10).collect()
    room = {}
    for r in got:
        room.setdefault(r.container_id, []).append(r.n_tokens)
    assert max(map(sum, room.values())) <= 8 and sum(len(v) for v in room.values()) == len(got)
    assert sorted(room) == list(range(len(room))) and sum(v == [8] for v in room.values()) >= 375


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "x" * 20_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 0


def test_rates():
    above = np.linspace(1000, 0, mixing.BINS + 1)
    for cap, wanted in ((1, 300), (3, 900), (4, 3500)):
        steps = mixing.poisson_steps(mixing.solve_rate(above, wanted, cap), cap)
        assert sum(1000 * (1 - s) for s in steps) == pytest.approx(wanted, rel=1e-3) and steps == sorted(steps)
    assert mixing.poisson_steps(mixing.solve_rate(above, 5000, 4), 4) == [-1.0] * 4
    assert mixing.solve_rate(above, 0, 2) == 0.0


def test_mix(spark):
    rows = [(i, "some words here " * (1 + i % 5), ["Big ", "small", None, "other"][0 if i % 10 else 1 + i % 3]) for i in range(3000)]
    rows += [(5000, None, "big"), (5001, "", "big"), (None, "x", "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, targets)
    copies = chosen.groupBy("doc_id", "source").count().collect()
    assert max(r["count"] for r in copies if r.source == "small") == 2 and max(r["count"] for r in copies if r.source == "big") == 1
    keys = [r.shuffle_key for r in chosen.collect()]
    assert keys == sorted(keys)
    by = {r.source: r for r in report.collect()}
    assert by["absent"].n_copies == 0 and sum(r.actual_share for r in by.values()) == pytest.approx(1)
    assert by["small"].n_copies == 2 * by["small"].n_docs
    empty, none = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and {r.actual_share for r in none.collect()} == {0.0}
