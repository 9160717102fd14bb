from collections import Counter

import numpy as np

from gristmill.llm import line_templates, term_bitmaps

LOG = "log_id bigint, fetch_url string, text string, _site string, leaf_a int"


def log(rows):
    return [(i, u, t, "clash", 1) for i, (u, t) in enumerate(rows, 1)]


def test_templates_fold_case_blanks_and_numbers():
    texts = ["Copyright  2005 X Lab \r", "copyright 7 x lab"]
    assert [[" ".join(t) for _, t in line_templates.template_tokens(x)] for x in texts] == [["copyright 0 x lab"]] * 2
    assert list(line_templates.template_tokens("123\n--\n\nA1b22")) == [(3, ["a0b0"])]


def test_repeated_lines(spark):
    page = "Share this 12\nown {}\nShare THIS 7"
    rows = [(f"http://www.h.example/{i}", page.format("xyz"[i % 3] * (i + 1))) for i in range(5)]
    rows += [("http://h.example:80/n", None), ("HTTP://H.EXAMPLE/e", ""), ("http://g.example/", "Share this 1"), (None, "Share this 1"), ("no url", "Share this 1")]
    df = spark.createDataFrame(log(rows), LOG)
    got = {tuple(r) for r in line_templates.repeated_lines(df).collect()}
    assert got == {(i, k) for i in range(1, 6) for k in (0, 2)}
    clean = {r.log_id: (r.text_clean, r.n_removed) for r in line_templates.without_repeated_lines(df).collect()}
    assert clean[1] == ("own x", 2) and clean[6] == (None, 0) and clean[7] == ("", 0) and len(clean) == 10
    assert line_templates.repeated_lines(df.limit(0)).count() == 0


def test_share_of_the_site_counts_rows_without_text(spark):
    rows = [("http://h.example/a", "Footer")] * 5 + [("http://h.example/b", None)] * 246
    assert line_templates.repeated_lines(spark.createDataFrame(log(rows), LOG)).count() == 0
    assert line_templates.repeated_lines(spark.createDataFrame(log(rows[:-1]), LOG)).count() == 5


def test_trees_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "MAX_LEAVES", 3)
    rows = [("http://h.example/a", "one\ntwo\nthree\none") for _ in range(6)]
    assert line_templates.repeated_lines(spark.createDataFrame(log(rows), LOG)).count() == 24


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 30_000):
        x = np.sort(rng.choice(1 << 16, n, replace=False))
        packed = term_bitmaps.pack(x)
        assert term_bitmaps.cardinality(packed) == n and (term_bitmaps.unpack(packed) == x).all()
    a, b = np.arange(0, 5000), np.arange(4000, 9000)
    assert term_bitmaps.cardinality(term_bitmaps.union([term_bitmaps.pack(a), term_bitmaps.pack(b)])) == 9000


def test_term_frequencies(spark):
    texts = ["a b a", "A c'd 9", None, "", "b b b"] * 30 + ["hot " * 9] * 5000
    rows = [(i * 7 + (1 << 16) - 40, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, "a", "x")], "log_id bigint, text string, term string").repartition(3)
    count, held = Counter(), {}
    for i, t, _ in rows + rows[:3]:
        for w in (t or "").lower().replace("9", "").split():
            count[w] += 1
            held.setdefault(w, set()).add(i)
    got = {r.term: (r.n_occurrences, r.n_rows) for r in term_bitmaps.term_frequencies(df, rows_per_map=700).collect()}
    assert got == {w: (count[w], len(held[w])) for w in count}
    marks = {r.term: r.mark for r in term_bitmaps.marked_terms(df).collect()}
    assert marks["hot"] == "common" and marks["a"] is None
    assert term_bitmaps.marked_terms(df.limit(0)).count() == 0
