import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import forest, layout, prose, reading, render, residue, spam

COMMON = frozenset("the of and to in is that for a with our every this we here der die und le la les".split())
PROSE = "The dog ran to the house and that was the end of the day for our team. " * 6
TABLE = "Name | Size | Day\n" + "\n".join(f"item | {i} | Mon {i}:30" for i in range(30))
PHRASES = "cheap vpn deal best vpn deal vpn deal online\n" * 20
LINKS = "\n".join(f"https://www.site{i}.example/page{i}" for i in range(20))


def test_statistics_of_many_texts_are_those_of_each():
    texts = [PROSE, None, "", TABLE, " \n", PHRASES, LINKS, "“Ünd” der\u00a0Ärger…\r\n• eins\n12) zwei\n\n", "a.\na.\nb", "int the = 1;", "x" * 3000 + " the"]
    common = prose.hashes_of(COMMON)
    both = prose.statistics(prose.lines_of([(t or "").encode() for t in texts], common))
    for k, t in enumerate(texts):
        assert tuple(x[k].item() for x in both) == prose.stats(t, COMMON), t
    names = [x.split()[0] for x in prose.STATS.split(", ")]
    got = dict(zip(names, prose.stats("One two, the end.\n- the bullet ...\n- the bullet ...\n# 7", COMMON), strict=True))
    assert got["n_words"] == 12 and got["n_common_words"] == 3 and got["bullet_line_share"] == 0.5 and got["ellipsis_line_share"] == 0.5
    assert got["punctuated_line_share"] == 0.75 and got["duplicate_line_share"] == 0.25 and got["symbol_ratio"] == 0.25


def test_found_rows_have_their_reason(spark):
    df = spark.createDataFrame([(1, PROSE), (2, TABLE), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.reasons for r in prose.with_reasons(prose.with_stats(df, COMMON)).collect()}
    assert prose.DECIDING in got[2] and prose.DECIDING not in got[1] and got[3] == []


def test_natural_share():
    share = lambda t: prose.stats(t, COMMON)[-1]
    assert share(PROSE) == 1 and share(PROSE.upper()) == 1 and share("- " + PROSE.strip().replace(". ", "\n- ")) == 1
    assert share(TABLE) == 0 and share(PHRASES) == 0 and share("int x = 1;\nfor (i = 0; i < 5; i++) { a[i] += the(); }") == 0
    assert share(None) == 0 and prose.stats("  \n", COMMON)[0] == 0
    assert share(PROSE + "\n" + TABLE) > 0.3


def test_reasons(spark):
    df = spark.createDataFrame([(1, PROSE), (2, TABLE), (3, None), (4, ""), (5, "w " * 100_001)], "doc_id bigint, text string")
    got = {r.doc_id: r.reasons for r in prose.with_reasons(prose.with_stats(df, COMMON)).collect()}
    assert got[1] == [] and got[2][0] == "mostly_outside_sentences" and got[3] == [] and got[4] == [] and "too_many_words" in got[5]


def test_stop_words_are_cleaned(spark):
    words = spark.createDataFrame([("The",), (" of ",), ("",), (None,), ("a b",), ("The",)], "word string")
    assert prose.stop_words(words) == {"the", "of", "a", "b"}


def test_spam(spark):
    rows = [(i, PROSE + "x" * (i % 7), f"http://h{i % 3}.example/") for i in range(60)] + [(100 + i, TABLE + str(i), None) for i in range(20)]
    rows += [(200 + i, PHRASES + f"vpn deal {i}", "http://s.example/") for i in range(15)] + [(300 + i, LINKS + f"/{i}", "http://s.example/") for i in range(15)]
    rows += [(400, None, None), (401, " ", "http://s.example/")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fetch_url string")
    got = {r.doc_id: r.p_spam for r in spam.scored(spam.with_features(df, COMMON)).collect()}
    assert {i for i, p in got.items() if p >= 0.5} == {i for i, _, _ in rows if 200 <= i < 400}
    assert 400 not in got and 401 not in got
    assert spam.scored(spam.with_features(df.limit(0), COMMON)).count() == 0


def test_forest_votes_alike_in_sql(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    trees = forest.train(x, y, n_trees=7)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(forest.vote(trees, ["a", "b", "c"])).collect()])
    assert ((got > 0.5) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Dear {{ first_name }}, welcome", 1), ("Price: ${price}", 1), ("%%ROOM%%", 1), ("[Insert title here]", 1), ("<date goes here>", 1), ("[object Object]", 1),
        ("404 Not Found", 1), ("Please enable JavaScript to view this page.", 1), ("Seite nicht gefunden", 1), ("Página no encontrada", 1),
        ("Lorem ipsum dolor sit amet", 1), ("Text text text text", 1), ("blah blah blah", 1),
        ("In the shell script the variable ${title} holds the name of the user.", -1),
        ("Ann Lee explained how the team traced a 500 Internal Server Error to a full disk.", -1),
        ("The old dog found the page in the book.", 0), ("self.x = [a for a in b]", 0), ("a[i] += b[i];", 0),
    ],
)
def test_trusted_labels(text, label):
    assert residue.label(text)[0] == label


def test_residue(spark):
    rows = [
        (1, PROSE + "\n{{ body }}"), (2, PROSE), (3, None), (4, ""), (5, PROSE + "\nInternal error while rendering widget abc: null reference"),
        (6, "Lorem ipsum dolor sit amet, tincidunt dapibus mollis. " * 5), (7, PROSE + "\nThe tutorial shows how a mark such as {{ body }} is swapped for a value."),
        (8, "Scripts and cookies must be allowed."), (9, "Scrpts and cookes must be allowed, javascript."),
    ]
    got = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: got.get(k) for k in (1, 2, 3, 4, 5, 6, 7, 8)} == {1: "field", 2: None, 3: None, 4: None, 5: "notice", 6: "filler", 7: None, 8: "notice"}
    assert residue.residue(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "ValueError: could not convert string", "NullPointerException: x", "400 Bad Request", "We could not find /x.", "It may have been moved.",
        "Try the search box instead.", "Request a new link.", "La session a expiré", "No se encontró el recurso", "test test", "bla bla bla",
        "story here", "Vestibulum faucibus viverra sagittis", "PLEAſE WAIT", "Oops!", "ORA-00942: x", "503 Service Temporarily Unavailable", "scrİpts and cookies",
    ],
)
def test_no_form_is_passed_over(text):
    assert [x[1] for x in residue.segments_of(PROSE + "\n" + text)] == [1]


def test_english_words_of_latin_stems_are_no_filler():
    assert residue.segments_of(PROSE + "\nadministrative interpretation facilitated each\n0 x portable interpretation") == []


def test_every_form_implies_the_guard():
    needs = [(x, p) for p in (residue.FILLER, residue.NOTICE) for x in residue._literals(p)]
    assert [p for x, p in needs if x is None] == [residue.FILLER]  # REPEATED, which is tested by itself
    literals = {z for x, _ in needs if x for z in x}
    assert literals == residue.LITERALS and [z for z in literals if len(z) < 4] == ["nan"]
    for z in literals - {"nan"}:
        assert residue.hinted(residue.segments([f"ab {z}cd".encode()]))[0].any(), z
    for x in residue.LATIN_WORDS | (residue.LATIN - residue.SHARED):
        assert residue.hinted(residue.segments([f"ab {x} cd".encode()]))[1].any(), x


def test_segments_of_many_texts_are_those_of_each():
    texts = [PROSE, "", "  ", "One. Two! three? “Four” 5.", "É 12 a\r\n- 3,4 x", "a", "x" * 70_000 + ". End", "…\n…", "no break. lower case", "{{ A }} of 17%"]
    both = residue.segments([t.encode() for t in texts])
    got = [(int(i), both.text(k)) for k, i in enumerate(both.owner)]
    alone = [(i, s.text(k)) for i, t in enumerate(texts) for s in [residue.segments([t.encode()])] for k in range(len(s))]
    assert got == alone and [t for i, t in got if i in (3, 4, 8, 9)] == ["one", "two! three?".replace("!", "").replace("?", ""), "“four” 0", "é 0 a", "0 0 x", "no break lower case", "{{ a }} of 0%"]
    nodes, prints, keys = residue.fingerprints(both)
    g = lambda t: [f" {t} "[i : i + 3] for i in range(len(t))]
    for k, x in enumerate(prints.tolist()):
        if both.text(k).isascii():
            codes = np.array([int.from_bytes(r.encode(), "little") for r in g(both.text(k))], np.uint32)
            bits = (residue._hashed(codes)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            assert x == sum(1 << b for b in range(64) if bits[:, b].sum() > len(codes) // 2)
    each = [residue.fingerprints(residue.segments([t.encode()])) for t in texts]
    assert (keys == np.concatenate([k for _, _, k in each])).all() and (residue.identities(both) == np.concatenate([n for n, _, _ in each])).all()


def test_labels_spread_through_components(spark):
    nodes = spark.createDataFrame([(1, 1, "notice"), (4, -1, "notice"), (5, 1, "field")], "node bigint, label int, kind string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 6), (5, 6), (7, 8)], "a bigint, b bigint")
    assert sorted((r.node, r.spread_kind) for r in residue.spread(nodes, edges).collect()) == [(2, "notice"), (3, "notice")]


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_reworded_notices_are_candidates(spark):
    import random

    base = [
        "this service is closed due to repairs of the store", "click the button below to continue to the site", "the requested item can't be shown to you now",
        "your browser has javascript turned off for this site", "change the settings of your account to see this text",
    ]
    rng, texts = random.Random(1), list(base)
    for t in base:
        for a, b in (("due to", "owing to"), ("continue", "go on"), ("requested", "wanted"), ("javascript", "javascirpt"), ("settings", "setting")):
            texts += [t.replace(a, b)] if a in t else []
        for n in (1, 2, 4):
            for _ in range(5):
                x = list(t)
                for _ in range(n):
                    x[rng.randrange(len(x))] = rng.choice("abcdefgh")
                texts.append("".join(x))
    texts = sorted(set(texts))
    wanted = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and _edit_distance(a, b) <= 0.2 * max(len(a), len(b))}
    left = residue.keyed(spark.createDataFrame([(i, x, "") for i, x in enumerate(texts)], "node bigint, text string, kind string"))
    right = left.select("node", "text", "print", "size", F.lit(False).alias("marked"), F.slice("keys", residue.BANDS + 1, residue.BANDS).alias("keys"))
    pairs = residue.near_pairs(residue.meetings(left, right, 0.8), left, right, 0.8)
    got = {(r.node, r.node2) for r in pairs.where("node < node2").collect()}
    assert got <= wanted and len(got) >= 0.95 * len(wanted) > 300, (len(got), len(wanted))


def test_all_segments_are_searched(spark):
    """Copies of trusted residue without words of notices, of more than 25 words or 400 letters, and
    copies of copies are found; filled fields and copies of what speaks about notices aren't."""
    long = "The page you requested was put away with many other old things of the house " + "that nobody has asked for in a long while " * 10
    rows = [
        (1, "It may have been moved."), (2, PROSE + "\nIt might have been moved."), (3, long), (4, PROSE + "\n" + long.replace("requested was", "wanted was")),
        (5, "Dear {{ first_name }}, we thank you for your kind letter of today"), (6, "Dear Ann, we thank you for your kind letter of today"), (7, PROSE),
        (8, "We could not find the thing that was asked for in our house"), (9, "We couldn't find the thing that was asked for in our home"),
        (10, "We wouldn't find a thing that was asked for in your home"),
        (11, "Ann Lee explained how the team traced a 500 Internal Server Error to a full disk"), (12, "Ann Lee explained how the team traced a 500 Internl Servr Error to a full disk"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    without = {r.doc_id for r in residue.residue(df, spreading=False).collect()}
    assert without == {1, 3, 5, 8}
    got = {r.doc_id: r.reason for r in residue.residue(df).collect()}
    assert got == {1: "notice", 2: "notice", 3: "notice", 4: "notice", 5: "field", 8: "notice", 9: "notice", 10: "notice"}


def test_edit_distances_of_many_pairs():
    import random

    rng, left, right = random.Random(4), [], []
    for _ in range(400):
        a = "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 2, 7, 20, 60, 130])))
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        left.append(a)
        right.append("".join(b))
    got = residue.alike(left, right, 0.8).tolist()
    want = [_edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in zip(left, right, strict=True)]
    assert got == want and 50 < sum(want) < 350


def test_keys_are_looked_up_by_their_leading_bits(spark):
    """All pairs that share a key are met; nearly all keys that no asking segment has are dismissed without a look at the lists."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("arn", "eld", "oss", "irk", "unt")]
    s = residue.segments([" ".join(rng.choice(words, 6)).encode() for _ in range(400)])
    front = residue.front_of(spark.createDataFrame([(k, s.text(k), "", k) for k in range(0, 400, 4)], "node bigint, text string, kind string, group bigint"))
    node, print_, least = residue._measured(s)
    keys = np.concatenate([residue._keys(least, s.size, i) for i in (-1, 0, 1)], axis=1)
    i, j = residue._met(front, node, print_, s.size, s.marked, keys, np.arange(400) % 5 == 0, 0.8, 64)
    own = residue._keys(least, s.size)[::4]
    met = (keys[:, None, :, None] == own[None, :, None, :]).any((2, 3)) & (np.abs(s.size[:, None] - front.size) <= 0.2 * np.maximum(s.size[:, None], front.size) + 1e-9)
    met[::5] = False
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(met)), strict=True)) and len(i) > 400
    assert np.unpackbits(front.seen).sum() <= len(front.keys) <= len(front.seen) * 8 / 32


def test_a_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Of many variants of one sentence, each is linked to what is known to be one group by one comparison, not by all; slices of a
    step and pieces of a batch lose nothing."""
    asked = []
    alike = residue.alike
    monkeypatch.setattr(residue, "alike", lambda a, b, t: asked.append(len(a)) or alike(a, b, t))
    names = [f"{a}{b}" for a in "bcdfghklmn" for b in ("arn", "eld", "oss", "irk", "unt")]
    texts = [f"{n} told us that the shop behind the old mill is closed for repairs".encode() for n in names]
    s = residue.segments(texts)
    front = residue.front_of(spark.createDataFrame([(k, s.text(k), "", 7) for k in range(25)], "node bigint, text string, kind string, group bigint"))
    node, linked, groups = residue._linked(front, s, np.zeros(0, np.uint64), 0.8)
    assert linked.tolist() == list(range(50)) and set(groups.tolist()) == {7} and sum(asked) < 100
    few = residue._may_meet(front, residue.segments([*texts, b"short one", PROSE.encode()]), 0.8)
    assert [few.text(k) for k in range(50)] == [s.text(k) for k in range(50)] and (residue.identities(few)[:50] == node).all()
    rows = [(i, f"It may have been moved to {n}.") for i, n in enumerate(names)] + [(100 + i, PROSE + f"\nIt might have been moved to {n}.") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {tuple(r) for r in residue.residue(df).collect()}
    monkeypatch.setattr(residue, "SLICE", 7)
    monkeypatch.setattr(residue, "PAIRS", 64)
    assert {r[0] for r in whole} == {r[0] for r in rows} and {tuple(r) for r in residue.residue(df).collect()} == whole


PAGE = """Skip navigation
Retragi Lab
Menu
Home > News > The long bridge of 2010
We and our partners store small files on your device. Accept all  Reject
The long bridge of 2010
By Ann Lee
Monday, 6/2/2021, 9:24 in Town
The bridge was built by the team in a long summer and it still stands.
- item one (3)
- Sponsored -
It was painted twice.
Related articles
Notes on the river (3 min read)
CS 120 Paint
Last modified: 1/9/2015
© 2013 Retragi Lab. All rights reserved."""


def test_furniture():
    got = layout.furniture(PAGE, "retragi.example", layout.MENU)
    assert got == [0, 1, 2, 3, 4, 10, 12, 13, 14, 15, 16]
    headless = "Related articles\nNotes on the river\nThe long bridge\nBy Ann Lee\nThe bridge was built by the team."
    assert layout.furniture(headless, None, layout.MENU) == [0, 1]
    assert layout.furniture("", None, layout.MENU) == [] and layout.furniture("One plain sentence is here.", None, layout.MENU) == []


def test_furniture_lines(spark):
    rows = [(1, PAGE, "http://retragi.example/"), (2, None, None), (3, " \n", None), (4, "Menu\n\nText of the page is here.", "nonsense")]
    df = spark.createDataFrame(rows, "log_id bigint, text string, fetch_url string")
    got = {tuple(r) for r in layout.furniture_lines(df).collect()}
    assert {r for r in got if r[0] != 1} == {(4, 0)} and len(got) == 12
    assert layout.furniture_lines(df.limit(0)).count() == 0


def test_render():
    page = "<body><nav>Menu</nav><h1>Head <i>line</i></h1><p>One\n two<p>Three<br>four<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>name<th>n<tr><td>long name<td>1</table><pre>x\n    y</pre><div hidden>no</div>"
    assert render.render(page, True) == "Head line\n\nOne two\n\nThree\nfour\n\n- a\n- b\n  - c\n\nname       n\nlong name  1\n\nx\n    y"
    assert render.render(None) == "" and render.render("plain  text") == "plain text" and render.render("<div>" * 3000 + "deep") == "deep"


def test_reading_levels(spark):
    easy, middle, hard = "cat dog sun red big hat run".split(), "budget table report meeting result".split(), "manifold functor lattice ergodic topology".split()
    rows, labels = [], []
    for i in range(120):
        band = 1 + i % 3
        own = [easy, easy + middle * 2, easy + middle + hard * 3][band - 1]
        rows.append((i, "the " + " the ".join(own[(i + k) % len(own)] for k in range(40))))
        labels.append((i, band))
    rows += [(500, None), (501, ""), (502, "zzz qqq"), (503, "der die das und ist nicht mit den dem cat")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    told = spark.createDataFrame(labels + [(0, None), (9999, 2), (1, 2)], "doc_id bigint, band int")
    model = reading.fit(df, told)
    assert model.grades["cat"] < model.grades["budget"] < model.grades["functor"]
    got = {r.doc_id: r for r in reading.with_level(df, model).collect()}
    assert sum(got[i].level == b for i, b in labels) >= 117
    assert got[500].level is None and got[501].level is None and got[502].level is None and not got[503].english
    none = reading.fit(df, told.limit(0))
    assert reading.with_level(df, none).where("level is not null").count() == 0


def test_levels_of_many_texts_are_those_of_each():
    grades = {"cat": 1.0, "dog": 1.25, "the": 0.5, "budget": 3.1, "lattice": 4.7, "von": 4.7}
    model = reading.Model(grades, [np.r_[-2.0, np.full(16, 0.1)], np.r_[-4.0, np.full(16, 0.1)]], [1, 2, 3])
    texts = ["the cat and the dog", None, "", "zzz", "der die das cat", "Lattice of the von budget; THE cat", "une café les lattice dog dog dog dog"] * 3
    level, known, english = (x.to_pylist() for x in reading.Measure(model)(texts))
    words = [reading.words_of(t) for t in texts]
    assert level == reading.levels([reading.quantiles(w, grades) for w in words], model) and len(set(level)) > 2
    assert known == [sum(x in grades for x in w) for w in words] and english == [reading.is_english(w) for w in words]
    assert [x.to_pylist() for x in reading.Measure(reading.Model({}, [], []))(["the cat", ""])] == [[None, None], [0, 0], [True, False]]


def test_extra_columns_do_no_harm(spark):
    df = spark.createDataFrame([(1, PROSE, "http://h.example/")], "doc_id bigint, text string, fetch_url string")
    wide = df.withColumn("_site", F.lit(1)).withColumn("n_words", F.lit(2)).withColumn("label", F.lit(3)).withColumn("place", F.lit(4))
    assert prose.with_stats(wide, COMMON).count() == 1 and spam.with_features(wide, COMMON).count() == 1 and residue.residue(wide).count() == 0
