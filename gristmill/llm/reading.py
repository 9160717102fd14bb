"""Problem 10: the reading level of each document.

A word's acquisition grade comes from the graded texts: its document rates by band are made
shares, and the grade is where their running sum, from the easiest band on, passes a small
part. A document is described by quantiles of the grades of its known words, distinct and in
running text, and by their means. They are calibrated against the graded texts: for each
border between bands a logistic weighting of the quantiles says whether a text lies above it,
and the level is the number of borders passed. Grades and weights are fitted on a bounded
sample of graded texts; every document is then measured over its whole text.

Documents without a known word get no level. A document counts as English if English function
words outnumber those of each other language. Labels without a document, null bands and
repeated labels are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.runtime import bounded_sample, cut

WORD = re.compile(r"[^\W\d_]+")
#: Of ASCII texts, words are found by blanking every other sign, which is faster.
_PLAIN = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))
#: At most so many graded documents fit the model.
SAMPLE = 10_000
#: A word needs so many graded documents to have a grade, and the running share that marks it as known.
MIN_DOCS, KNOWN = 4, 0.2
QUANTILES = (0.25, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with by at from this be or which an were our every each one while",
    "de": "der die das und ist nicht mit den dem ein eine auf im zu von des sich wird auch aber oder nach bei als",
    "fr": "le la les des et est une un dans pour que avec du au sur pas ce qui en mais ou par après sans",
    "es": "el la los las de y en un una que para con por del se al es lo pero sin después como más",
}
WORDS_OF = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES = {w: tuple(k for k, v in WORDS_OF.items() if w in v) for w in frozenset().union(*WORDS_OF.values())}


@dataclass
class Model:
    grades: dict[str, float]
    borders: list[np.ndarray]  # per border between neighbouring bands: constant and weights of the quantiles
    bands: list[int]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return low.translate(_PLAIN).split() if low.isascii() else WORD.findall(low)


def is_english(words: list[str]) -> bool:
    said = dict.fromkeys(WORDS_OF, 0)
    for word, n in Counter(filter(_LANGUAGES.__contains__, words)).items():
        for language in _LANGUAGES[word]:
            said[language] += n
    return said["en"] > max(said["de"], said["fr"], said["es"])


def _spread(grades: list[float]) -> list[float]:
    grades.sort()
    last = len(grades) - 1
    return [grades[round(q * last)] for q in QUANTILES] + [sum(grades) / len(grades)]


def quantiles(words: list[str], grades: dict[str, float]) -> list[float] | None:
    """Quantiles and mean of the grades of the known words, distinct and with repeats."""
    return _described(words, [g for g in map(grades.get, words) if g is not None], grades)


def _described(words: list[str], running: list[float], grades: dict[str, float]) -> list[float] | None:
    if not running:
        return None
    return _spread([g for g in map(grades.get, set(words)) if g is not None]) + _spread(running)


def acquisition(counts: dict[int, int], sizes: dict[int, int]) -> float:
    """Where the running share of a word's rates passes KNOWN, interpolated within the band."""
    rates = {b: counts.get(b, 0) / n for b, n in sizes.items()}
    total, run = sum(rates.values()), 0.0
    for b in sorted(rates):
        share = rates[b] / total
        if share and run + share >= KNOWN:
            return b + (KNOWN - run) / share - KNOWN
        run += share
    return float(max(sizes))


def border(x: np.ndarray, above: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Constant and weights of a penalised logistic regression of ``above`` on the quantiles."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge, z.T @ (above - p) - ridge @ w)
    slope = w[1:] / spread
    return np.r_[w[0] - slope @ mean, slope]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Word grades and borders from at most ``sample`` graded documents."""
    told = labels.where("band is not null").groupBy(id_col).agg(F.min("band").alias("band"))
    told = bounded_sample(told, id_col, sample, seed=11)
    kept = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    graded = cut(kept.join(F.broadcast(told), id_col).select("band", "text"))  # bounded by the sample

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(set(words_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["band", "words"])

    sizes = {r.band: r.n for r in graded.groupBy("band").agg(F.count("*").alias("n")).collect()}
    per_band = graded.mapInArrow(distinct, "band int, words array<string>").select("band", F.explode("words").alias("word")).groupBy("word", "band").count()
    known = per_band.groupBy("word").agg(F.collect_list(F.struct("band", "count")).alias("c")).where(F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["count"]) >= MIN_DOCS)
    grades = {r.word: acquisition({x["band"]: x["count"] for x in r.c}, sizes) for r in known.collect()}
    bands = sorted(sizes)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [quantiles(words_of(t), grades) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["band", "q"])

    pairs = graded.mapInArrow(describe, "band int, q array<double>").where("q is not null").collect()
    if not pairs:
        return Model({}, [], bands)
    band, q = np.array([r.band for r in pairs]), np.array([r.q for r in pairs])
    return Model(grades, [border(q, (band >= upper).astype(float)) for upper in bands[1:]], bands)


def levels(rows: list[list[float] | None], model: Model) -> list[int | None]:
    known = [i for i, q in enumerate(rows) if q is not None]
    out: list[int | None] = [None] * len(rows)
    if known and model.bands:
        x = np.array([rows[i] for i in known])
        passed = sum((w[0] + x @ w[1:] > 0).astype(int) for w in model.borders) if model.borders else np.zeros(len(x), int)
        for i, n in zip(known, passed.tolist(), strict=True):
            out[i] = model.bands[n]
    return out


LEVEL = "level int, n_known bigint, english boolean"


class Measure:
    """Level, known words and language of many texts at once. Words are numbered by their grade, so the
    numbers of a text's words in order give its grades in order."""

    def __init__(self, model: Model) -> None:
        self.model = model
        ranked = sorted(model.grades, key=model.grades.get)
        others = sorted(_LANGUAGES.keys() - model.grades.keys())
        self.known, self.number = len(ranked), {w: k for k, w in enumerate([*ranked, *others])}
        self.grade = np.array([model.grades[w] for w in ranked], float)
        self.said = {k: np.array([w in words for w in self.number], bool) for k, words in WORDS_OF.items()}

    def __call__(self, texts: list) -> list[pa.Array]:
        n, size, number = len(texts), len(self.number), self.number
        found = [[k for k in map(number.get, words_of(text)) if k is not None] for text in texts]
        of = np.repeat(np.arange(n), np.fromiter(map(len, found), np.int64, n))
        codes = np.sort(of * size + np.fromiter(chain.from_iterable(found), np.int64, len(of)))
        of, words = codes // size, codes % size
        said = {k: np.bincount(of[marks[words]], minlength=n) for k, marks in self.said.items()}
        english = said["en"] > np.maximum(np.maximum(said["de"], said["fr"]), said["es"])
        graded = words < self.known
        codes, of, grades = codes[graded], of[graded], self.grade[words[graded]]
        fresh = np.r_[True, np.diff(codes) > 0] if len(codes) else np.zeros(0, bool)
        parts = [_spreads(grades[x], np.searchsorted(of[x], np.arange(n + 1))) for x in (fresh, slice(None))]
        rows = [a + b if a else None for a, b in zip(*parts, strict=True)]
        known = np.bincount(of, minlength=n)
        return [pa.array(levels(rows, self.model), pa.int32()), pa.array(known.astype(np.int64)), pa.array(english)]


def _spreads(grades: np.ndarray, bounds: np.ndarray) -> list[list[float]]:
    """``_spread`` of each text's grades, which are in order; empty without any."""
    last = np.diff(bounds) - 1
    some = last >= 0
    at = bounds[:-1][some][:, None] + np.round(last[some][:, None] * np.array(QUANTILES)).astype(np.int64)
    picked, values = iter(grades[at].tolist()), grades.tolist()
    return [[*next(picked), sum(values[a:b]) / (b - a)] if a < b else [] for a, b in pairwise(bounds.tolist())]


def measurer(spark: SparkSession, model: Model) -> Callable[[list], list[pa.Array]]:
    """A function of texts that gives the columns of LEVEL; the model is bounded by its sample."""
    shared = spark.sparkContext.broadcast(Measure(model))
    return lambda texts: shared.value(texts)


def with_level(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, level, n_known, english) of every document."""
    measure = measurer(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *measure(batch.column(1).to_pylist())], [id_col, "level", "n_known", "english"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {LEVEL}")
