"""Problem 5: per-document text quality statistics and the rules applied to them.

One pass over the whole texts gives their statistics, which are computed for a batch of texts at
once on its bytes; fixed-threshold rules then say why a document is not natural prose, one recorded
reason per rule it fails. The first rule decides: more than half of the words stand outside natural
sentences. A line is natural if function words make up enough of it, or of it and its neighbours
(hard wraps); layout, case, bullets and full stops do not matter.

A null or blank text has no statistics but its zero counts, fails no rule and is never a case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that end or part words of a sentence; others, as in "n/a" or "no|yes", do not.
STOPS = ",.!?;:\"()“”„«»¿¡…"
#: Lines of program code, whose keywords look like function words.
CODE = re.compile(r"[{}]|!=|==|->|\+=|= \[|^\s*(?:def|int|return|#define|#include|import|class|//)\b|^\s*//|;\s*/\*")
#: Common words that also stand in cells of tables.
CELLS = frozenset(["no", "yes", "n", "a/n"])
#: Share of function words from which a line counts as natural language.
NATURAL = 0.2

STATS = (
    "n_words bigint, mean_word_length double, symbol_ratio double, bullet_line_share double, "
    "ellipsis_line_share double, punctuated_line_share double, common_word_share double, n_common_words bigint, "
    "alphabetic_share double, duplicate_line_share double, natural_share double"
)


def stop_words(words: DataFrame) -> frozenset[str]:
    """The common words, trimmed and in lower case; a small fixed table (checked)."""
    rows = words.select(F.lower(F.trim("word")).alias("w")).where("w <> ''").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of common words is not a small table")
    # A line of a list holding several words, parted by white space, is several words.
    return frozenset(w for r in rows for w in r.w.split()) - CELLS


def _bytes_of(signs: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in signs if ord(c) < 128])


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_STOP = _BLANK | _bytes_of(STOPS)
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bytes without one of which a line is no code, unless it begins with one of CODE_WORDS.
_CODE = _bytes_of("{}=>#/")
CODE_WORDS = ("def", "int", "return", "import", "class")
#: UTF-8 of blanks and of signs of STOPS that are not ASCII.
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_STOPS = [c.encode() for c in STOPS if not c.isascii()]
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, 0x9E3779B97F4A7C15, np.uint64)])


def _places(raw: np.ndarray, high: np.ndarray, signs: list[bytes]) -> np.ndarray:
    """Places of all bytes of the given signs, which are not ASCII; ``high``: places of such bytes."""
    out = []
    for sign in signs:
        at = high[raw[high] == sign[0]]
        for k in range(1, len(sign)):
            at = at[raw[np.minimum(at + k, len(raw) - 1)] == sign[k]]
        out += [at + k for k in range(len(sign))]
    return np.concatenate(out) if out else high[:0]


@dataclass
class Lines:
    """Non-blank lines of some texts and their words.

    Per line: number of its text, number among the text's lines, place of its bytes, words, common words,
    whether it is natural. Per word: its line and a hash. ``raw``: bytes of all texts, each between line ends.
    """

    raw: np.ndarray
    n_texts: int
    bounds: np.ndarray
    blank: np.ndarray
    high: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sizes: np.ndarray
    known: np.ndarray
    natural: np.ndarray
    word_line: np.ndarray
    words: np.ndarray

    def per_text(self, values: np.ndarray | None = None) -> np.ndarray:
        """Sums of values of lines (default 1) by text."""
        return np.bincount(self.owner, values, self.n_texts)

    def line(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def _word_hashes(low: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and 64-bit hash of each word: each byte is weighed by its place in the word."""
    begins = ~stop & np.r_[True, stop[:-1]]
    at = np.flatnonzero(begins)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    size = np.diff(np.r_[0, at, len(low)])
    spot = np.arange(len(low), dtype=np.int32) - np.repeat(np.r_[0, at].astype(np.int32), size)
    weight = _POWERS[spot & 255]
    if size.max() > 256:
        weight *= np.uint64(1) + (spot >> 8).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    weight *= low + np.uint64(1)
    weight[stop] = 0
    h = np.add.reduceat(weight, at)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return at, h ^ (h >> np.uint64(32))


def hashes_of(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of words in lower case; what holds a sign of STOPS is never a word."""
    kept = [w.encode() for w in words if w and not any(c in STOPS or c.isspace() for c in w)]
    raw = np.frombuffer(b"\n".join([b"", *kept, b""]), np.uint8)
    return np.unique(_word_hashes(raw, _BLANK[raw])[1])


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def lines_of(texts: list[bytes], common: np.ndarray) -> Lines:
    """The lines with a word of some texts; ``common``: hashes of the common words (``hashes_of``)."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    high = np.flatnonzero(raw >= 128)
    blank, stop, low = _BLANK[raw], _STOP[raw], _LOW[raw]
    if len(high):
        wide = _places(raw, high, _WIDE_BLANKS)
        blank[wide] = True
        stop[wide] = True
        stop[_places(raw, high, _WIDE_STOPS)] = True
        at = high[(raw[high] == 0xC3)] + 1
        at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
        low[at] += 32
    ends = np.flatnonzero(raw == 10)
    place, words = _word_hashes(low, stop)
    line = np.searchsorted(ends, place) - 1  # line k lies between ends k and k + 1
    n_lines = len(ends) - 1
    sizes = np.bincount(line, minlength=n_lines)
    known = np.bincount(line, among(words, common), minlength=n_lines).astype(np.int64)
    starts_code = np.zeros(n_lines, bool)
    if len(place):
        opening = np.r_[True, line[1:] != line[:-1]]
        starts_code[line[opening]] = among(words[opening], _CODE_HASHES)
    signs = np.flatnonzero(_CODE[raw])
    suspect = (known > 0) & (starts_code | (np.searchsorted(signs, ends[1:]) > np.searchsorted(signs, ends[:-1])))
    for k in np.flatnonzero(suspect).tolist():
        if CODE.search(raw[ends[k] + 1 : ends[k + 1]].tobytes().decode("utf-8", "replace")):
            known[k] = 0
    kept = np.flatnonzero(sizes > 0)
    start = ends[:-1][kept] + 1
    owner = np.searchsorted(bounds, start, "right") - 1
    of_text = np.searchsorted(ends, bounds[:-1])
    rank = np.full(n_lines, -1)
    rank[kept] = np.arange(len(kept))
    n, k = sizes[kept], known[kept]
    return Lines(raw, len(texts), bounds[:-1], blank, high, owner, kept - of_text[owner], start, ends[1:][kept], n, k, _natural(owner, n, k), rank[line], words)


def _natural(owner: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which lines are natural: enough common words in the line, or in it and its neighbours."""
    flags = k >= NATURAL * n
    if len(n) > 2:
        inner = (owner[2:] == owner[:-2]) & (n[1:-1] <= 16) & (10 * k[1:-1] >= n[1:-1])
        both = k[:-2] + k[1:-1] + k[2:] >= NATURAL * (n[:-2] + n[1:-1] + n[2:])
        flags[1:-1] |= inner & both & (k[:-2] > 0) & (k[2:] > 0)
    return flags


_CODE_HASHES = hashes_of(CODE_WORDS)
_BULLETS = _bytes_of("-*+>")
_WIDE_BULLETS = [c.encode() for c in "•·–▪‣"]
_END, _QUOTE, _SYMBOL = _bytes_of(".!?:"), _bytes_of('"'), _bytes_of("#{|~")
_WIDE_QUOTE, _ELLIPSIS = "”".encode(), "…".encode()
_ALPHA = np.array([chr(c).isascii() and chr(c).isalpha() or 0xC3 <= c <= 0xDF or 0xE3 <= c <= 0xEF for c in range(256)])


def _at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return raw[np.clip(at, 0, len(raw) - 1)]


def _is(raw: np.ndarray, at: np.ndarray, sign: bytes) -> np.ndarray:
    return np.logical_and.reduce([_at(raw, at + k) == b for k, b in enumerate(sign)])


def statistics(s: Lines) -> list[np.ndarray]:
    """STATS of each text."""
    raw, blank, rows = s.raw, s.blank, np.maximum(1, s.per_text())
    owner_of = lambda places: np.searchsorted(s.bounds, places, "right") - 1
    n = s.per_text(s.sizes)
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    token_owner = owner_of(begins)
    tokens = np.bincount(token_owner, minlength=s.n_texts)
    whole = ~blank
    whole[s.high[(raw[s.high] >> 6) == 2]] = False  # bytes within a sign
    letters = np.add.reduceat(whole.astype(np.int64), begins) if len(begins) else np.zeros(0)
    chars = np.bincount(token_owner, letters, s.n_texts)
    alpha = np.flatnonzero(_ALPHA[raw])
    has_alpha = np.searchsorted(alpha, np.r_[begins[1:], len(raw)]) > np.searchsorted(alpha, begins)
    alphabetic = np.bincount(token_owner, has_alpha, s.n_texts)
    dots = np.flatnonzero(raw == 46)
    runs = np.r_[0, np.flatnonzero(np.diff(dots) > 1) + 1] if len(dots) else dots
    triples = np.diff(np.r_[runs, len(dots)]) // 3
    signs = np.bincount(owner_of(np.flatnonzero(_SYMBOL[raw])), minlength=s.n_texts) + np.bincount(owner_of(dots[runs]), triples, s.n_texts)
    signs = signs + np.bincount(owner_of(s.high[_is(raw, s.high, _ELLIPSIS)]), minlength=s.n_texts)
    solid = np.flatnonzero(~blank)
    first, last = solid[np.searchsorted(solid, s.start)] if len(solid) else s.start, solid[np.searchsorted(solid, s.end) - 1] if len(solid) else s.end
    bullet = _BULLETS[_at(raw, first)] & _at(blank, first + 1)
    for sign in _WIDE_BULLETS:
        bullet |= _is(raw, first, sign) & _at(blank, first + len(sign))
    digit = lambda x: (x >= 48) & (x <= 57)
    at = first.copy()
    for _ in range(3):
        at += digit(_at(raw, at)) & (at - first < 3)
    mark = _at(raw, at)
    bullet |= (at > first) & ((mark == 46) | (mark == 41)) & _at(blank, at + 1)
    ellipsis = _is(raw, last - 2, b"...") | _is(raw, last - 2, _ELLIPSIS)
    quoted = np.where(_QUOTE[_at(raw, last)], last - 1, np.where(_is(raw, last - 2, _WIDE_QUOTE), last - 3, np.where(_is(raw, last - 1, b".)"), last - 1, last)))
    full = _END[_at(raw, quoted)] & ~((quoted < last) & (_at(raw, quoted) == 58)) | _is(raw, last - 2, _ELLIPSIS)
    same = _line_hashes(s, last)
    order = np.lexsort((same, s.owner))
    fresh = np.r_[True, (np.diff(s.owner[order]) != 0) | (same[order][1:] != same[order][:-1])] if len(same) else order.astype(bool)
    distinct = np.bincount(s.owner[order], fresh, s.n_texts)
    some, words = np.maximum(1, tokens), np.maximum(1, n)
    known = s.per_text(s.known)
    out = [
        n, chars / some, signs / words, s.per_text(bullet) / rows, s.per_text(ellipsis) / rows, s.per_text(full) / rows, known / words, known, alphabetic / some,
        np.where(s.per_text() > 0, 1 - distinct / rows, 0.0), s.per_text(s.sizes * s.natural) / words,
    ]
    return [np.where(n > 0, x, 0) for x in out]


def _line_hashes(s: Lines, last: np.ndarray) -> np.ndarray:
    """Length and a hash of 32 bits of each line up to its last sign that is no blank; compared within one text."""
    if not len(s.start):
        return np.zeros(0, np.uint64)
    spans = np.stack([s.start, np.minimum(last + 1, len(s.raw) - 1)], 1).ravel()
    spot = np.arange(len(s.raw), dtype=np.uint32) - np.repeat(np.r_[0, s.start].astype(np.uint32), np.diff(np.r_[0, s.start, len(s.raw)]))
    x = (s.raw + np.uint32(1)) * (spot * np.uint32(0x9E3779B1) | np.uint32(1))
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return np.add.reduceat(x, spans)[::2].astype(np.uint64) | (last - s.start).astype(np.uint64) << np.uint64(32)


#: Texts are taken together up to so many bytes; a longer one by itself.
CHUNK = 400_000


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and bytes of the texts (null: none) of each chunk of a column."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        held.append(text or b"")
        size += len(held[-1])
        if size > CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def stats(text: str | None, common: frozenset[str]) -> tuple:
    """STATS of one text."""
    return tuple(x[0].item() for x in statistics(lines_of([(text or "").encode("utf-8", "replace")], hashes_of(common))))


_TYPES = [pa.int64() if c.split()[1] == "bigint" else pa.float64() for c in STATS.split(", ")]


def stat_arrays(s: Lines) -> list[pa.Array]:
    return [pa.array(x.astype(np.int64) if t == pa.int64() else x.astype(float), t) for x, t in zip(statistics(s), _TYPES, strict=True)]


#: What the deciding rule looks at.
DECIDING_STATS = "n_words bigint, natural_share double"


def deciding_arrays(s: Lines) -> list[pa.Array]:
    n = s.per_text(s.sizes)
    return [pa.array(n.astype(np.int64)), pa.array(s.per_text(s.sizes * s.natural) / np.maximum(1, n))]


def with_stats(df: DataFrame, common: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS of every document."""
    table = hashes_of(common)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *stat_arrays(lines_of(texts, table))], names)

    names = [id_col, *(c.split()[0] for c in STATS.split(", "))]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(measure, f"`{id_col}` {kind}, {STATS}")


#: The rule that decides here; the others are recorded beside it.
DECIDING = "mostly_outside_sentences"


def rules(prefix: str = "") -> dict[str, Column]:
    """Reason and condition of each rule, over columns of STATS with a prefix; thresholds as published for filters of web text, but
    for the first, which is the definition of the cases here."""
    c = lambda name: F.col(prefix + name)
    return {
        DECIDING: c("natural_share") < 0.5,
        "too_few_words": c("n_words") < 50,
        "too_many_words": c("n_words") > 100_000,
        "mean_word_length": ~c("mean_word_length").between(3, 10),
        "symbols": c("symbol_ratio") > 0.1,
        "bullets": c("bullet_line_share") > 0.9,
        "ellipses": c("ellipsis_line_share") > 0.3,
        "few_alphabetic_words": c("alphabetic_share") < 0.8,
        "few_common_words": c("n_common_words") < 2,
        "few_full_lines": c("punctuated_line_share") < 0.12,
        "repeated_lines": c("duplicate_line_share") > 0.3,
    }


def with_reasons(measured: DataFrame) -> DataFrame:
    """``reasons``: the rules a document fails, in order; empty without text."""
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules().items()]))
    return measured.withColumn("reasons", F.when(F.col("n_words") > 0, failed).otherwise(F.array().cast("array<string>")))
