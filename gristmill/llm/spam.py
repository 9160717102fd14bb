"""Problem 3: keyword-stuffed and link-list pages.

Content and link features of each whole text; weak labels where they are beyond doubt;
bagged decision trees trained on a bounded sample of the weakly labelled pages; predictions
smoothed with the spam rate of the page's host.

The features leave out a first short line (a title). Null and blank texts are never cases.
Pages without a host are judged by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.site import site
from gristmill.llm import forest, prose
from gristmill.runtime import bounded_sample

#: At most so many weakly labelled pages train the trees.
SAMPLE = 10_000

URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,9}/\S*", re.I)
TAG = re.compile(r"(?<!\S)#[\w-]*[^\W\d][\w-]*")
PRICE = re.compile(r"(?:[$€£]\s?\d+(?:[.,]\d\d)?|\d+[.,]\d\d\s?(?:EUR|USD|GBP|€|\$|£))|\bin stock\b|\bsold out\b|\badd to cart\b", re.I)
#: Article numbers of products, as "OR-17656".
ARTICLE = re.compile(r"\b[A-Z]{1,4}-\d{3,7}\b")
OFFER = re.compile(r"[$€£]|\b(?:EUR|USD|GBP|in stock|sold out|add to cart)\b|\b[A-Z]{1,4}-\d{3}", re.I)
BARE = re.compile(r"\.[a-z]{2,9}/", re.I)
DIGIT = re.compile(r"\d")
LABEL = re.compile(r"\s*(?:tags?|keywords?|labels?|categories)\s*:", re.I)
MARK = re.compile(
    r"^\W*(?:visit|click here|go to|see|more|open|read)\b.{0,5}[:»A-Z]|read more\s*$|\[open\]|\(link\)|»\s*$|^\s*[›»]\s|^\W*(?:partner|related|useful) (?:sites|links)\W*$",
    re.I,
)
#: What matches MARK holds one of these.
MARK_SIGNS = ("more", "open", "read", "see", "visit", "go to", "click here", "»", "›", "(link)", "sites", "links")
PART = re.compile(r"\s+[|/·»›•~]+\s+")
#: Words by which sellers widen search phrases.
SALES = frozenset(
    "buy cheap best price prices discount affordable online order deal deals coupon coupons sale wholesale free "
    "shipping shop store near me usa uk review reviews comparison top official trusted original download today "
    "offer offers looking cheapest bargain stock".split()
)

FEATURES = [
    "url_share", "url_line_share", "tag_share", "offer_share", "price_line_share", "label_line_share", "mark_line_share", "caption_share",
    "sales_share", "common_share", "natural_share", "phrase_share", "digit_share", "words_per_line", "joined_share", "evidence",
]
SIGNS = (
    "url_share", "url_line_share", "tag_share", "offer_share", "price_line_share", "label_line_share", "mark_line_share",
    "caption_share", "phrase_share",
)


def feature_rows(texts: list[bytes], s: prose.Lines, common: frozenset[str]) -> np.ndarray:
    """FEATURES of each text (texts x FEATURES); ``s``: their lines. All but the shares of common and natural
    words look at the lines that are no natural sentences, and are measured by words against the whole text."""
    opens = np.r_[True, s.owner[1:] != s.owner[:-1]] if len(s.owner) else np.zeros(0, bool)
    keep = ~(opens & (s.per_text()[s.owner] > 2) & (s.sizes <= 14))
    owner, n, known, number = s.owner[keep], s.sizes[keep], s.known[keep], s.number[keep]
    natural = prose._natural(owner, n, known)
    of = lambda x: np.bincount(owner, x, len(texts))
    words, rows = of(n), np.maximum(1, np.bincount(owner, minlength=len(texts)))
    some = np.maximum(1, words)
    out = np.zeros((len(texts), len(FEATURES)))
    for name, x in (("common_share", of(known) / some), ("natural_share", of(n * natural) / some), ("words_per_line", words / rows)):
        out[:, FEATURES.index(name)] = x
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rest = ~natural
    for i in np.flatnonzero(of(rest) > 0).tolist():
        a, b = bounds[i], bounds[i + 1]
        text = texts[i].decode("utf-8", "replace")
        lines = text.split("\n")
        left = rest[a:b]
        parts = [(lines[j], m, k) for j, m, k in zip(number[a:b][left].tolist(), n[a:b][left].tolist(), known[a:b][left].tolist(), strict=True)]
        _measure(out[i], text, parts, int(words[i]), common)
    return out


def _measure(row: np.ndarray, text: str, rest: list[tuple[str, int, int]], n: int, common: frozenset[str]) -> None:
    """Fill in the features of a text of ``n`` words that look at its lines outside sentences: (line, words, common words)."""
    body = "\n".join(x[0] for x in rest)
    urls = offers = url_lines = price_lines = label_lines = mark_lines = captions = joined = tags = 0.0
    bare = body
    if "://" in body or "www." in body or BARE.search(body):
        bare = URL.sub(" ", body)
        urls = (len("".join(body.split())) - len("".join(bare.split()))) / len("".join(text.split()))
        url_lines = sum(x[1] for x in rest if x[2] <= 0.2 * x[1] and URL.search(x[0]))
    raw = bare.split()
    total = max(n, 1)
    if "#" in bare:
        tags = len(TAG.findall(bare))
    if OFFER.search(bare):
        offers = len(PRICE.findall(bare)) + len(ARTICLE.findall(bare))
        price_lines = sum(x[1] for x in rest if PRICE.search(x[0]))
    for line, size, k in rest:
        if ":" in line and LABEL.match(line):
            label_lines += size
        if size <= 12 and k <= 0.4 * size:
            small = line.lower()
            if any(x in small for x in MARK_SIGNS) and MARK.search(line):
                mark_lines += size
        if k <= 0.15 * size:
            parts = PART.split(line.strip())
            if len(parts) >= 3:
                captions += sum(m for p in parts if 2 <= (m := len(p.split())) <= 6 and not DIGIT.search(p))
    # Phrases are of neighbouring plain words: tokens with digits or signs inside part them.
    low = [x.strip(",.;:!?\"'()*-") for x in bare.lower().split()]
    plain = [t if t.isalpha() and t not in common else "" for t in low]
    pairs = Counter(a + " " + b for a, b in zip(plain, plain[1:], strict=False) if a and b)
    if "-" in bare or "_" in bare:
        joined = sum(1 for t in raw if ("-" in t or "_" in t) and len(t) > 8 and not SALES.isdisjoint(re.split("[-_#]", t.lower())))
    found = {
        "url_share": urls,
        "url_line_share": url_lines / n,
        "tag_share": tags / total,
        "offer_share": min(1.0, 6 * offers / n),
        "price_line_share": price_lines / n,
        "label_line_share": label_lines / n,
        "mark_line_share": mark_lines / n,
        "caption_share": captions / n,
        "sales_share": sum(map(SALES.__contains__, low)) / total,
        "phrase_share": sum(c for _, c in pairs.most_common(6) if c > 2) * 2 / total,
        "digit_share": sum(1 for t in raw if DIGIT.search(t)) / total,
        "joined_share": joined / total,
    }
    # The strongest single sign of spam: its kinds are many, and each page shows but one or two.
    found["evidence"] = max(*(found[k] for k in SIGNS), min(1.0, 3 * found["sales_share"]), min(1.0, 3 * found["joined_share"]))
    for name, x in found.items():
        row[FEATURES.index(name)] = x


def with_features(
    df: DataFrame,
    common: frozenset[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    url_col: str = "fetch_url",
    stats: str = "",
    also: tuple[str, Callable[[list], list[pa.Array]]] | None = None,
) -> DataFrame:
    """id, site and FEATURES of every document with text; with ``stats`` its text statistics as well (``s_``
    before their names): "all", or "deciding" for what the deciding rule of text quality looks at; on demand
    with the columns of ``also``: their schema, and a function of texts.
    """
    table = prose.hashes_of(common)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in prose.chunks(batch.column(2)):
                lines = prose.lines_of(texts, table)
                rows = feature_rows(texts, lines, common)
                columns = [pa.array(rows[:, k]) for k in range(len(FEATURES))]
                columns += measures[stats](lines)
                columns += also[1]([t.decode("utf-8", "replace") for t in texts]) if also else []
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:2]), *columns], names)

    measures = {"": lambda s: [], "all": prose.stat_arrays, "deciding": prose.deciding_arrays}
    more = [f"s_{x}" for x in {"": [], "all": prose.STATS.split(", "), "deciding": prose.DECIDING_STATS.split(", ")}[stats]]
    more += also[0].split(", ") if also else []
    names = [id_col, "_site", *FEATURES, *(x.split()[0] for x in more)]
    source = df.where(F.trim(F.col(text_col)) != "").select(id_col, site(F.col(url_col)).alias("_site"), text_col)
    kind = df.schema[id_col].dataType.simpleString()
    return source.mapInArrow(measure, ", ".join([f"`{id_col}` {kind}", "_site string", *(f"{f} double" for f in FEATURES), *more]))


def weak_label() -> Column:
    """1: spam beyond doubt, 0: none beyond doubt, null: not told."""
    c = F.col
    spam = (
        (c("url_share") > 0.5)
        | ((c("url_line_share") > 0.6) & (c("natural_share") < 0.4))
        | (c("tag_share") > 0.4)
        | ((c("offer_share") > 0.5) & (c("natural_share") < 0.4))
        | ((c("price_line_share") > 0.5) & (c("natural_share") < 0.4))
        | ((c("label_line_share") > 0.5) & (c("natural_share") < 0.4))
        | ((c("mark_line_share") > 0.6) & (c("natural_share") < 0.4))
        | ((c("caption_share") > 0.6) & (c("digit_share") < 0.2))
        | ((c("sales_share") > 0.15) & (c("phrase_share") > 0.2) & (c("natural_share") < 0.4))
        | ((c("phrase_share") > 0.6) & (c("natural_share") < 0.3) & (c("digit_share") < 0.2))
    )
    quiet = (
        (c("url_share") < 0.1) & (c("url_line_share") < 0.2) & (c("tag_share") < 0.05) & (c("price_line_share") < 0.1) & (c("offer_share") < 0.1) & (c("sales_share") < 0.08)
        & (c("label_line_share") < 0.3) & (c("mark_line_share") < 0.3) & (c("caption_share") < 0.3)
    )
    clean = quiet & ((c("natural_share") > 0.7) | (c("phrase_share") < 0.4))
    return F.when(spam, 1.0).when(clean, 0.0)


def train(measured: DataFrame, sample: int = SAMPLE) -> list[forest.Node]:
    """Trees from at most ``sample`` weakly labelled pages, half of them spam where there are enough."""
    labelled = measured.withColumn("label", weak_label()).where("label is not null")
    parts = []
    for label in (1.0, 0.0):
        chosen = bounded_sample(labelled.where(F.col("label") == label), measured.columns[0], sample // 2, seed=3)
        parts.append(np.array([list(r) for r in chosen.select(*FEATURES).collect()], float).reshape(-1, len(FEATURES)))
    if not len(parts[0]) or not len(parts[1]):
        return []
    x, y = np.concatenate(parts), np.r_[np.ones(len(parts[0])), np.zeros(len(parts[1]))]
    return forest.train(x, y)


def scored(measured: DataFrame, id_col: str = "doc_id", smoothing: float = 0.4, prior_pages: float = 20.0, sample: int = SAMPLE) -> DataFrame:
    """id, site, p_page, host_rate, p_spam of every measured document (``with_features``, cut).

    The host's rate is shrunk towards the corpus's by ``prior_pages`` pages, and moves the
    page's log-odds by ``smoothing`` times the difference of their log-odds.
    """
    trees = train(measured, sample)
    pages = measured.select(id_col, "_site", forest.vote(trees, FEATURES).alias("p_page"))
    per_host = pages.groupBy("_site").agg(F.sum("p_page").alias("spam"), F.count("*").alias("pages"))
    corpus = per_host.agg((F.sum("spam") / F.sum("pages")).alias("rate"))
    hosts = (
        per_host.where("_site is not null")
        .crossJoin(F.broadcast(corpus))  # one row
        .select("_site", "rate", ((F.col("spam") + prior_pages * F.col("rate")) / (F.col("pages") + prior_pages)).alias("host_rate"))
    )
    odds = lambda p: F.log(F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)) / (1 - F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))))
    joined = pages.join(hosts, "_site", "left")
    shift = F.coalesce(smoothing * (odds(F.col("host_rate")) - odds(F.col("rate"))), F.lit(0.0))
    return joined.select(
        id_col,
        F.col("_site").alias("site"),
        "p_page",
        "host_rate",
        (1 / (1 + F.exp(-(odds(F.col("p_page")) + shift)))).alias("p_spam"),
    )
