"""Problem 7: template residue, filler and error-page text.

Each whole text is cut into segments (lines and sentences). Trusted labels say which segments
are unfilled template fields, filler or notices, and which speak about such things in their
own sentences. All other segments are open: they and the trusted ones meet in MinHash tables,
pairs are verified by the Hamming distance of their SimHashes and by the similarity of their
texts, and trusted labels spread through the connected components. A document is a case if it
holds a field or a notice, or consists of filler. Null and blank texts are never cases.

Segments, their table keys and SimHashes are found for a whole batch of texts at once, on its
bytes. Only components that hold trusted residue can give a label, so pairs are searched outward
from it, until nothing new is reached: each step holds the keys of the segments found by the last
one in every task and passes over all texts, whose pairs are verified where they are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.prose import chunks
from gristmill.operators.components import connected_components
from gristmill.runtime import cut

#: The forms in which template languages and editors mark a field to be filled.
FIELD = re.compile(
    r"\{\{[^{}\n]+\}\}|[$#]\{[\w. ]+\}|\$!\{?[A-Za-z]\w*|%\(\w+\)[sd]|%%[A-Z][A-Z_]*%%|\[\[[\w ]+\]\]"
    r"|<%[=-]?[^%\n]+%>|<\?(?:php|=)[^>\n]+\?>|\{%[^%\n]+%\}|@(?:Model|ViewBag)\.\w+|__[A-Z][A-Z_]*[A-Z]__"
    r"|(?<![\w~])~[A-Z][A-Z_]*[A-Z]~|\[(?:your|insert|enter|add|name of)\b[^\[\]\n]*\]|<[\w ]+ goes here>"
    r"|(?<![\w$#{%])\{[a-z][a-z_]+\}(?!\})|\[object Object\]|<<[A-Z][A-Z_ ]*>>|(?<![\w%])%[a-z]+_?[a-z]*%(?![\w%])",
    re.I,
)
FIELD_SIGNS = ("{", "[", "<", "%", "@", "~", "__", "$!")
#: Forms whose letters must be capitals; the pattern above ignores case for the others' sake.
CAPITALS = re.compile(r"^(?:%%|__|~)")
#: Stems of the customary pseudo-Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet conse adipi elit tinci dapib molli sodal bland nibh felis nibhe euism portt augue nulla "
    "turpe turpi quist quis variu massi massa fring ornar fauci sempe viver aenea hendr lacin liber curse cursu ultri "
    "egest sagit morbi velat velit ligun ligul tempr tempo tempu pelle rhonc vitae porta element vesti place phare "
    "feugi sapie matti iacul orci dui nunc sed justo eros preti aliqu congu facil ullam laore vulpu inter magna".split()
)
#: Stems that living languages share ("interpretation facilitated"); in texts without one of
#: LATIN_WORDS, two words of other stems are asked for.
SHARED = frozenset(
    "conse inter facil porta place magna tempo tempr liber curse cursu elit nulla bland massi massa molli sit sed justo eros dolor viver sapie vesti felis dui".split()
)
LATIN_WORDS = frozenset("lorem ipsum dolor dolore amet".split())
#: Phrases of filler text.
FILLER = re.compile(
    r"\b(?:text text|blind text|dummy text|sample text|example content|placeholder (?:copy|text)|filler text|blah blah|asdf|foo bar|qwerty"
    r"|xxxx|tbd tbd|(?:title|subtitle|text|content|heading|story) here|text goes here|replace (?:it|this|me) with your own|test post please ignore)\b"
    r"|^(\w+)(?: \1){2,}\b|^heading \d+\W*$|^(?:null|undefined|nan)(?: (?:null|undefined|nan))*\W*$|^test(?: test)+\b",
    re.I,
)
#: Phrases of error messages and of notices about access, login, upkeep, loading, scripts and cookies.
NOTICE = re.compile(
    r"\b(?:[45]\d\d (?:not found|forbidden|internal server error|bad gateway|service (?:temporarily )?unavailable|unauthorized|gateway time-?out|bad request|gone)"
    r"|error establishing|could not connect to (?:the )?database|failed to load resource|internal error while|traceback \(most recent|undefined (?:index|variable|offset|function)"
    r"|call to undefined|allowed memory size|error in your sql syntax|table or view \S+ does not exist|invalid or missing token|request a new link|session (?:has )?(?:expired|timed out)"
    r"|please (?:log|sign) in|(?:log|sign) ?in (?:is )?required|you (?:must|need to|have to) (?:log|sign) in|you do not have (?:the rights|permission)|permission denied|access (?:was )?denied"
    r"|page (?:you are looking for|you requested|seems to be missing|is gone|(?:was|is|could) not (?:be )?found|cannot be (?:found|displayed)|no longer exists)|we could not find|may have been moved"
    r"|try the search box|go back to the (?:start|home) ?page|something went wrong|unexpected error|an error (?:has )?occurred|please (?:try again|reload|check back)|try again (?:later|in a)"
    r"|(?:down|closed) for maintenance|being upgraded|temporarily unavailable|server is overloaded|be right back|under construction"
    r"|checking your browser|security check|enable (?:javascript|cookies|scripts)|(?:javascript|scripts?|cookies) (?:is|are|must be) (?:disabled|required|allowed|enabled|off|needed|blocked|turned on)"
    r"|(?:turn|switch) on (?:javascript|scripts|cookies)|(?:needs?|requires?) (?:javascript|scripts|cookies)|work properly without javascript|without javascript enabled|browser is (?:not supported|out of date|too old)|update your browser"
    r"|scripts and cookies|not have permission|rights to open|message does not go away"
    r"|seite nicht gefunden|angeforderte seite|javascript in (?:ihrem|deinem) browser|bitte (?:aktivieren|melden sie sich an|anmelden)|zugriff verweigert|sitzung ist abgelaufen|wartungsarbeiten|fehler ist aufgetreten"
    r"|p[áa]gina no encontrada|p[áa]gina ya no existe|no se (?:ha )?encontr|acceso denegado|(?:active|activar?|habilite|habilitar) javascript|sesi[óo]n ha (?:caducado|expirado)|en mantenimiento|se ha producido un error"
    r"|page introuvable|cette page n.existe plus|acc[èe]s (?:refus|interdit)|activ(?:er|ez) javascript|session a expir|en maintenance|une erreur (?:est survenue|s.est produite))"
    r"|^\W*(?:loading(?: content)?(?:, please wait)?\W*|please wait\W*|http \d{3}\b.{0,30}|(?:http )?error:? \d{3}\b.{0,40}|\d{3} error|oops!?|uh-oh\W*|(?:fatal|parse) error:|warning:|notice: undefined|deprecated:|(?:\w+error|\w+exception|ora-\d+): .*|not found\W*|forbidden\W*|unauthorized\W*"
    r"|service unavailable\W*|login required\W*|down for maintenance\W*|file \"/\S+\", line \d+.*)",
    re.I,
)
#: The one form without a fixed literal: a word said three times at the start of a segment.
REPEATED = re.compile(r"\b(\w+)(?: \1){2,}\b", re.I)
#: Letters that a pattern without regard to case takes for ASCII ones, though lower() doesn't.
_FOLD = str.maketrans({"ſ": "s", "ı": "i", "İ": "i"})


def fold(text: str) -> str:
    return text.translate(_FOLD).lower() if not text.isascii() else text.lower()


def _needed(parsed) -> frozenset[str] | None:
    """Literals of which every match of a parsed pattern holds at least one."""
    options, run, todo = [], "", [(None, None), *reversed(list(parsed))]
    while todo:
        op, arg = todo.pop()
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        if op is _parser.MAX_REPEAT and arg[0] > 0:
            todo += [(_parser.ANY, None), *reversed(list(arg[2]))]  # once, then anything
            continue
        if op is _parser.SUBPATTERN and not any(x is _parser.BRANCH for x, _ in arg[3]):
            todo += reversed(list(arg[3]))
            continue
        if run:
            options.append(frozenset([fold(run)]))
        run, inner = "", None
        if op is _parser.BRANCH:
            inner = [_needed(x) for x in arg[1]]
            inner = None if None in inner else frozenset().union(*inner)
        elif op is _parser.SUBPATTERN:
            inner = _needed(arg[3])
        if inner:
            options.append(inner)
    return max(options, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _ways(seq: list) -> list[list]:
    """A parsed pattern with its nested branches taken apart, as many sequences without branches."""
    for k, (op, arg) in enumerate(seq):
        if op is _parser.BRANCH:
            return [y for x in arg[1] for y in _ways([*seq[:k], *x, *seq[k + 1 :]])]
        if op is _parser.SUBPATTERN and arg[0] is None:
            return _ways([*seq[:k], *arg[3], *seq[k + 1 :]])
    return [seq]


def _literals(pattern: re.Pattern) -> list[frozenset[str] | None]:
    """Needed literals of each alternative of a pattern; None for REPEATED, which has but a space."""
    ways = _ways(list(_parser.parse(pattern.pattern, pattern.flags)))
    return [x if (x := _needed(way)) and min(map(len, x)) > 1 else None for way in ways]


#: Derived from the forms: every match of FILLER or NOTICE holds one of these, or is REPEATED.
LITERALS = frozenset().union(*(x for p in (FILLER, NOTICE) for x in _literals(p) if x))


def _automaton(words: frozenset[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in sorted(words):
        out.add_word(word, 1)
    out.make_automaton()
    return out


#: A segment without any of these holds no filler or notice (but for REPEATED and pseudo-Latin).
HINTS = _automaton(LITERALS)
#: Words by which a sentence speaks of something instead of being it: verbs of telling and holding, and
#: Things that tell or are spoken of. General vocabulary (see ``speaks``), of which only long segments are judged.
TELLS = frozenset(
    "says said say tells told tell explains explained explain shows showed show means meant describes described holds held contains stands reads returns "
    "returned teaches taught learned learnt asks asked prints printed quotes quoted mentions discusses discussed "
    "erklärt erklärte erklärten zeigt zeigte beschreibt bedeutet explica explicó explicaron muestra mostró describe significa explique expliqua montre montra décrit signifie".split()
)
THINGS = frozenset(
    "log logs message messages tutorial manual chapter book lecture script scripts variable variables syntax placeholder placeholders template templates "
    "mark marks reply replies answer code codes term phrase string article essay student students "
    "fehler meldung handbuch skript variable platzhalter vorlage mensaje manual guion plantilla marcador registro message manuel gabarit modèle journal".split()
)
HOW = frozenset("how that why whether what wie warum dass cómo que comment pourquoi".split())


def speaks(words: list[str]) -> bool:
    """A word of telling after a thing that tells, or right before "how", "that" or the like."""
    for i, w in enumerate(words):
        if w in TELLS and (not HOW.isdisjoint(words[i + 1 : i + 3]) or not THINGS.isdisjoint(words[max(0, i - 7) : i])):
            return True
    return False


WORDS = re.compile(r"\w+")


def label(segment: str, literal: bool = True, latin: bool = True) -> tuple[int, str]:
    """Trusted label and kind of a segment: 1 residue, -1 speaks about it, 0 open. ``literal``, ``latin``:
    whether it may hold one of LITERALS, or pseudo-Latin (see ``hinted``)."""
    kind, words = "", WORDS.findall(segment.lower()) if latin else []
    if any(x in segment for x in FIELD_SIGNS):
        for m in FIELD.finditer(segment):
            if not CAPITALS.match(m[0]) or m[0].upper() == m[0]:
                kind = "field"
                break
    if not kind and words:
        stems = [w[:5] for w in words if w[:5] in LATIN]
        sure = not LATIN_WORDS.isdisjoint(words)
        if len(stems) >= max(2, 0.5 * len(words)) and (sure or sum(1 for x in stems if x not in SHARED) >= 2):
            return 1, "filler"
    if not kind and (literal and next(HINTS.iter(fold(segment)), None) is not None or REPEATED.match(segment)):
        kind = "filler" if FILLER.search(segment) else "notice" if NOTICE.search(segment) else ""
    if not kind:
        return 0, ""
    words = words or WORDS.findall(segment.lower())
    long = len(words) >= (9 if kind != "filler" else 7)
    return (-1 if long and speaks(WORDS.findall(FIELD.sub(" x ", segment).lower())) else 1), kind


#: Tables, and minima of hashes of runs of three signs that key a table.
BANDS, ROWS = 16, 3
#: Hamming distance of the SimHashes of a pair, at most; two words in ten changed flip about 17 bits, unlike texts differ in 32.
MAX_DISTANCE = 22
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Signs of fields that count as parts of a text; texts with one are marked.
_SIGNS = b"{}[]<>~_%$#@"
_SUSPECT = np.isin(np.arange(256), np.frombuffer(b"{[<%@~_$", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"{[<~_", np.uint8))


def _letters() -> np.ndarray:
    """What each byte becomes: letters lower-case, digits 0, signs of fields themselves, all else a blank."""
    out = np.full(256, 32, np.uint8)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalnum():
            out[c] = ord("0") if chr(c).isdigit() else ord(chr(c).lower())
        elif c in _SIGNS or c >= 128:
            out[c] = c
    return out


_PLAIN = _letters()


def _slots(c: np.ndarray, size: int) -> np.ndarray:
    """Slots in a table of 2**22 of all windows of ``size`` (4 or 6) folded signs."""
    x = c.astype(np.uint32)
    g = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    more = x[3:] if size == 4 else g[3:]
    return (g[: len(more)] * np.uint32(0x9E3779B1) ^ more * np.uint32(0x85EBCA6B)) >> np.uint32(10)


def _rare_windows() -> dict[int, np.ndarray]:
    """By size of window, marks of the slots of the window of rarest letters of each literal (1), and of the
    starts of words by which pseudo-Latin is known (2). What holds a literal holds its window."""
    out, often = {4: np.zeros(1 << 22, np.uint8), 6: np.zeros(1 << 22, np.uint8)}, " etaoinshrdlcumwfgypbvkjxqz"
    for literal in sorted(LITERALS):
        folded = _PLAIN[np.frombuffer(literal.encode(), np.uint8)].tobytes()
        folded = re.sub(b"0+", b"0", re.sub(b" +", b" ", folded))
        folded = folded if len(folded) > 3 else b" " + folded  # the one form of so short a literal begins its segment
        size = 6 if len(folded) >= 6 else 4
        windows = [folded[i : i + size] for i in range(len(folded) - size + 1)]
        best = max(windows, key=lambda w: sum(often.find(chr(x)) % 32 for x in w))
        out[size][_slots(np.frombuffer(best, np.uint8), size)] |= 1
    for stem in LATIN_WORDS | (LATIN - SHARED):
        window = f" {stem} "[:6].encode()
        size = len(window) // 2 * 2
        out[size][_slots(np.frombuffer(window[:size], np.uint8), size)] |= 2
    return out


_RARE = _rare_windows()
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: Last bytes of . ! ? and …, and first bytes of what may open a sentence: capitals, quotes, brackets, other scripts.
_CLOSE = np.isin(np.arange(256), [*b".!?", 0xA6])
_OPEN = (np.arange(256) >= 128) | np.isin(np.arange(256), np.frombuffer(b'ABCDEFGHIJKLMNOPQRSTUVWXYZ"([{', np.uint8))


@dataclass
class Segments:
    """Segments of some texts: number of their text, places in the raw and the folded bytes, words,
    length, whether they are marked, and suspect of a field or a repeated word."""

    raw: np.ndarray
    plain: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    n_words: np.ndarray
    size: np.ndarray
    marked: np.ndarray
    suspect: np.ndarray

    def __len__(self) -> int:
        return len(self.owner)

    def raw_text(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")

    def text(self, k: int) -> str:
        return self.plain[self.first[k] : self.last[k]].tobytes().decode("utf-8", "replace")


def _within(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether any of some sorted places lies in each span."""
    return np.searchsorted(places, end) > np.searchsorted(places, start)


def segments(texts: list[bytes], sentences: bool = True) -> Segments:
    """The segments of texts, found on all bytes at once; without ``sentences``, whole lines. A break is a run of white space that holds a
    line end, or that follows an end mark and precedes what may open a sentence. Folded, a segment
    is in lower case (ASCII and Latin-1), digits of a number are one 0, and all but letters, digits
    and signs of fields is one blank; segments of fewer than two signs are left out."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    blank = _BLANK[raw]
    starts = np.flatnonzero(blank & ~np.r_[False, blank[:-1]])
    ends = np.flatnonzero(blank & ~np.r_[blank[1:], False])
    cuts = _within(np.flatnonzero(raw == 10), starts, ends + 1)
    if sentences:
        cuts |= _CLOSE[raw[np.maximum(starts - 1, 0)]] & _OPEN[raw[np.minimum(ends + 1, len(raw) - 1)]]
    a, b = ends[cuts][:-1] + 1, starts[cuts][1:]
    low = _PLAIN[raw]
    low[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 32
    keep = np.r_[True, ((low[1:] != 32) | (low[:-1] != 32)) & ((low[1:] != 48) | (low[:-1] != 48))]
    plain, place = np.r_[low[keep], np.uint8(32)], np.cumsum(keep)
    first, last = place[a] - keep[a], place[np.maximum(b - 1, 0)]
    first += plain[np.minimum(first, len(plain) - 1)] == 32
    last -= plain[np.maximum(last - 1, 0)] == 32
    whole = last - first >= 2
    a, b, first, last = a[whole], b[whole], first[whole], last[whole]
    blanks = plain == 32
    at = np.flatnonzero(blanks)
    # Words are known by their length and first letters; three alike in a row may be a repeated word.
    size, begin = np.diff(at), plain[at[:-1] + 1].astype(np.int64) | (plain[np.minimum(at[:-1] + 2, len(plain) - 1)].astype(np.int64) << 8)
    alike = (size[1:] == size[:-1]) & (begin[1:] == begin[:-1])
    again = at[:-3][alike[1:] & alike[:-1]] if len(at) > 3 else at[:0]
    suspect = _within(np.flatnonzero(_SUSPECT[plain]), first, last) | _within(again, first - 1, last)
    n_words = np.searchsorted(at, last) - np.searchsorted(at, first) + 1
    inner = np.flatnonzero((plain >> 6) == 2)  # bytes within a sign
    size = last - first - np.searchsorted(inner, last) + np.searchsorted(inner, first)
    return Segments(raw, plain, np.searchsorted(bounds, a, "right") - 1, a, b, first, last, n_words, size, _within(np.flatnonzero(_MARKS[plain]), first, last), suspect)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _runs(s: Segments, size: int = 65536) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of ``s`` that keep arrays within the processor's cache: which segments, the codes of all
    runs of three folded signs, where each segment's runs begin and end (for ``_over``), and how many they are."""
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(s.last, s.first[at] + size)))
        a, b = int(s.first[at]) - 1, int(s.last[to - 1]) + 2
        c = s.plain[a:b].astype(np.uint32)
        lo, hi = s.first[at:to] - 1 - a, s.last[at:to] - 1 - a
        yield slice(at, to), c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16)), np.stack([lo, hi], 1).ravel(), hi - lo
        at = to


def _over(op: np.ufunc, x: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``op`` over the runs of each segment."""
    return op.reduceat(x, index)[::2]


def _hashed(g: np.ndarray) -> np.ndarray:
    return _mix(g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B19E3779F9))


def _identity(g: np.ndarray, wide: np.ndarray, index: np.ndarray) -> np.ndarray:
    lo = index[::2]
    spot = (np.arange(len(g), dtype=np.int64) - np.repeat(lo, np.diff(np.r_[lo, len(g)]))).astype(np.uint64)
    return _mix(_over(np.add, wide * (spot * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)), index))


def identities(s: Segments) -> np.ndarray:
    """64 bits that tell folded texts apart."""
    parts = [_identity(g, _hashed(g), index) for _, g, index, _ in _runs(s)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _measured(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identities, SimHashes and minima (segments x BANDS ROWS) of segments."""
    node, print_, least = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64), np.zeros((BANDS * ROWS, len(s)), np.uint32)
    for part, g, index, own in _runs(s):
        wide = _hashed(g)
        node[part], print_[part] = _identity(g, wide, index), _simhash(wide, index, own)
        h = (wide >> np.uint64(32)).astype(np.uint32)
        buf = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.multiply(h, _FACTORS[k], out=buf)
            least[k, part] = _over(np.minimum, buf, index)
    return node, print_, least


def _keys(least: np.ndarray, size: np.ndarray, shift: int = 0) -> np.ndarray:
    """Table keys (segments x BANDS) of minima and the level of length; ``shift`` is added to the level, so
    that texts meet whose lengths are on neighbouring levels."""
    level = np.floor(np.log(np.maximum(1, size)) / np.log(1.25)).astype(np.int64) + shift + 1
    keys = np.empty((len(size), BANDS), np.uint32)
    for t in range(BANDS):
        a, b, c = (least[t * ROWS + i].astype(np.uint64) for i in range(ROWS))
        key = _mix((level + t * 4096).astype(np.uint64) ^ (a << np.uint64(32) | b)) ^ c
        keys[:, t] = _mix(key) >> np.uint64(32)
    return keys


def fingerprints(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identities, SimHashes and table keys (segments x BANDS).

    A key is of ROWS minima over the hashed runs of three signs and the level of length. Texts whose
    runs have a share j in common meet in some table with the chance 1 - (1 - j**3)**16. Tables of
    parts of SimHashes can't be used: a changed word in ten flips 4 to 12 bits of 64.
    """
    node, print_, least = _measured(s)
    return node, print_, _keys(least, s.size)


def hinted(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Whether a segment may hold one of LITERALS, and whether it may hold pseudo-Latin."""
    # Signs that a pattern without regard to case takes for ASCII letters: long s, i with and without a dot, Kelvin.
    odd = np.zeros(0, np.int64)
    if len(high := np.flatnonzero(s.raw[:-1] >= 0x84)):
        a, b = s.raw[high], s.raw[high + 1]
        odd = high[((a == 0xC5) & (b == 0xBF)) | ((a == 0xC4) & ((b == 0xB0) | (b == 0xB1))) | ((a == 0x84) & (b == 0xAA))]
    literal = _within(odd, s.start, s.end)
    latin = literal.copy()
    for size, table in _RARE.items():
        if len(s.plain) > size:
            marks = table[_slots(s.plain, size)]
            at = np.flatnonzero(marks)
            for bit, out in ((1, literal), (2, latin)):
                out |= _within(at[(marks[at] & bit) > 0], s.first - 1, s.last + 1)
    return literal, latin


def _simhash(wide: np.ndarray, index: np.ndarray, own: np.ndarray) -> np.ndarray:
    """SimHash of each segment over its hashed runs, repeats counted. Bits are summed in lanes of 8;
    segments of more runs than a lane holds are summed apart."""
    out, buf, lane = np.zeros(len(own), np.uint64), np.empty_like(wide), np.uint64(0x0101010101010101)
    for shift in range(8):
        np.right_shift(wide, np.uint64(shift), out=buf)
        np.bitwise_and(buf, lane, out=buf)
        counts = np.ascontiguousarray(_over(np.add, buf, index)).view(np.uint8).reshape(-1, 8)  # little-endian: byte k counts bit 8 k + shift
        bits = (counts > (own // 2)[:, None]).astype(np.uint8)
        out |= np.ascontiguousarray(bits).view(np.uint64).ravel() << np.uint64(shift)
    for k in np.flatnonzero(own > 255).tolist():
        each = np.unpackbits(wide[index[2 * k] : index[2 * k + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[k] = np.packbits(each.sum(axis=0, dtype=np.int64) > own[k] // 2, bitorder="little").view(np.uint64)[0]
    return out


def trusted(s: Segments) -> list[tuple[int, int, str]]:
    """(segment, label, kind) of the trusted segments."""
    out, (literal, latin) = [], hinted(s)
    for k in np.flatnonzero(s.suspect | literal | latin).tolist():
        sign, kind = label(s.raw_text(k), bool(literal[k]), bool(latin[k]))
        if sign:
            out.append((k, sign, kind))
    return out


def segments_of(text: str) -> list[tuple[str, int, str, int]]:
    """Trusted segments of a text: folded text, label, kind, words."""
    s = segments([text.encode("utf-8", "replace")])
    return [(s.text(k), sign, kind, int(s.n_words[k])) for k, sign, kind in trusted(s)]


_TRUSTED = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("label", pa.int32()), ("kind", pa.string()), ("n_words", pa.int32())]))
_SCAN = "total bigint, trusted array<struct<node:bigint,text:string,label:int,kind:string,n_words:int>>"


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, words in all and the trusted segments of every document that has some."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                s = segments(texts)
                told = trusted(s)
                if not told:
                    continue
                at = np.array([k for k, _, _ in told])
                rows: dict[int, list[dict]] = {}
                for (k, sign, kind), node in zip(told, _identities_of(s, at).tolist(), strict=True):
                    one = {"node": node, "text": s.text(k), "label": sign, "kind": kind, "n_words": int(s.n_words[k])}
                    rows.setdefault(int(s.owner[k]), []).append(one)
                docs, total = np.fromiter(rows, np.int64, len(rows)), np.bincount(s.owner, s.n_words, len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs + first)), pa.array(total[docs]), pa.array(list(rows.values()), _TRUSTED)], [id_col, "total", "trusted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, {_SCAN}")


def _identities_of(s: Segments, at: np.ndarray) -> np.ndarray:
    """Identities of some segments, signed."""
    return identities(replace(s, owner=s.owner[at], first=s.first[at], last=s.last[at])).view(np.int64)


#: Kinds of signs that are counted: letters, 0, blank, other ASCII, beginnings of other signs; 31 is not counted.
_KINDS = np.array([c - 97 if 97 <= c <= 122 else 26 if c == 48 else 27 if c == 32 else 28 if c < 128 else 31 if c < 192 else 29 for c in range(256)])


def _spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def _bags(s: Segments, at: np.ndarray) -> np.ndarray:
    """How many signs of each kind some segments have (up to 255): an edit changes one count up and one down at most."""
    size = s.last[at] - s.first[at]
    row = np.repeat(np.arange(len(at)) * 32, size) + _KINDS[s.plain[_spans(size, s.first[at])]]
    bags = np.minimum(np.bincount(row, minlength=32 * len(at)), 255).astype(np.uint8).reshape(-1, 32)
    bags[:, 31] = 0
    return bags


#: Segments that are asked from in one pass over the texts, which bounds what a task holds (about 250 bytes each).
SLICE = 400_000
#: Pairs looked at together.
PAIRS = 1 << 20


@dataclass
class Front:
    """Segments that are asked from: identity, SimHash, length, whether a field, what they are known to be linked with
    (``group``), kinds of signs and text; and their table keys in order, with the segment of each. ``starts``: where the
    keys of equal leading bits begin; ``seen``: by more leading bits, whether there is such a key at all."""

    node: np.ndarray
    print: np.ndarray
    size: np.ndarray
    field: np.ndarray
    group: np.ndarray
    bag: np.ndarray
    texts: pa.Array
    keys: np.ndarray
    who: np.ndarray
    shift: int
    starts: np.ndarray
    seen: np.ndarray


def _front(table: pa.Table, print_: np.ndarray, size: np.ndarray, bag: np.ndarray, keys: np.ndarray) -> Front:
    column = lambda name: table.column(name).combine_chunks()
    order = np.argsort(keys.ravel(), kind="stable")
    ranked = keys.ravel()[order].astype(np.uint32)
    bits = int(min(24, max(8, np.ceil(np.log2(1 + len(order))))))
    seen = np.zeros(1 << min(27, bits + 5), bool)
    seen[ranked >> np.uint32(32 - min(27, bits + 5))] = True
    starts = np.searchsorted(ranked >> np.uint32(32 - bits), np.arange((1 << bits) + 1)).astype(np.int32)
    field = np.array(column("kind").to_pylist(), object) == "field"
    node, group = column("node").to_numpy().view(np.uint64), column("group").to_numpy()
    return Front(node, print_, size, field, group, bag, column("text"), ranked, (order // keys.shape[1]).astype(np.int32), 32 - bits, starts, np.packbits(seen, bitorder="little"))


def front_of(asked: DataFrame) -> Front:
    """``asked`` (node, text, kind, group), SLICE rows at most, for the tasks."""
    table, parts = asked.select("node", "text", "kind", "group").toArrow(), []
    for batch in table.to_batches():
        for _, texts in chunks(batch.column(1)):
            s = segments(texts, sentences=False)
            _, print_, least = _measured(s)
            parts.append((print_, s.size, _bags(s, np.arange(len(s))), _keys(least, s.size)))
    return _front(table, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _within_reach(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """The most edits that leave texts of these lengths similar enough."""
    return np.floor((1 - similarity) * np.maximum(a, b) + 1e-9).astype(np.int64)


def _met(front: Front, node: np.ndarray, print_: np.ndarray, size: np.ndarray, marked: np.ndarray, keys: np.ndarray, barred: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of segments (numbers, not ``barred``) and of ``front`` that share a key, whose SimHashes are within ``most``
    and whose lengths allow for the similarity."""
    width, flat = keys.shape[1], keys.ravel()
    place = flat >> np.uint32(30 - len(front.seen).bit_length())
    hits = np.flatnonzero((front.seen[place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8)) & 1)
    hits = hits[~barred[hits // width]]
    bucket = (flat[hits] >> np.uint32(front.shift)).astype(np.int64)
    low = front.starts[bucket].astype(np.int64)
    n = front.starts[bucket + 1] - low
    ends, out, at = np.cumsum(n), [np.zeros(0, np.int64)], 0
    while at < len(hits):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        entry, by = _spans(n[at:to], low[at:to]), np.repeat(hits[at:to], n[at:to])
        same = front.keys[entry] == flat[by]
        i, j = by[same] // width, front.who[entry[same]].astype(np.int64)
        near = np.bitwise_count(print_[i] ^ front.print[j]) <= most
        i, j = i[near], j[near]
        close = (np.abs(size[i] - front.size[j]) <= _within_reach(size[i], front.size[j], similarity)) & (node[i] != front.node[j]) & (~front.field[j] | marked[i])
        out.append(np.unique(i[close] * len(front.node) + j[close]))
        at = to
    pairs = np.unique(np.concatenate(out))
    return pairs // len(front.node), pairs % len(front.node)


def alike(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Which pairs of texts are within the edit distance that ``similarity`` allows for their lengths. All pairs are
    gone through together, along the diagonals that so few edits can reach."""
    out = np.zeros(len(left), bool)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    most, order = _within_reach(sizes[:, 0], sizes[:, 1], similarity), np.argsort(sizes.max(1), kind="stable")
    at = 0
    while at < len(order):
        room = max(1, PAIRS // (3 * int(sizes[order[at]].max()) + 8))
        part = order[at : at + room]
        part = part[sizes[part].max(1) <= 1.3 * sizes[part[0]].max() + 8]
        at += len(part)
        out[part] = _edits([left[k] for k in part], [right[k] for k in part], sizes[part], most[part])
    return out


def _edits(left: list[str], right: list[str], sizes: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``; entry k of a row is the diagonal k - reach."""
    reach, (long, wide) = int(most.max()), sizes.max(0)
    a, b = np.full((len(left), long), -1, np.int32), np.full((len(left), reach + max(long, wide) + reach + 1), -2, np.int32)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        a[k, : len(x)] = np.frombuffer(x.encode("utf-32-le", "replace"), np.int32)
        b[k, reach : reach + len(y)] = np.frombuffer(y.encode("utf-32-le", "replace"), np.int32)
    out, live, steps = np.zeros(len(left), bool), np.arange(len(left)), np.arange(2 * reach + 1, dtype=np.int32)
    far = np.int32(1 << 29)
    row = np.tile(np.where(steps >= reach, steps - reach, far), (len(left), 1))
    for i in range(long + 1):
        if i:
            row = row + (a[:, i - 1 : i] != b[:, i - 1 : i + 2 * reach])
            row[:, :-1] = np.minimum(row[:, :-1], last[:, 1:] + 1)
            row = np.minimum.accumulate(row - steps, axis=1) + steps
        ended = np.flatnonzero(sizes[:, 0] == i)
        if len(ended):
            apart = sizes[ended, 1] - i
            inner = np.abs(apart) <= most[ended]
            out[live[ended[inner]]] = row[ended[inner], apart[inner] + reach] <= most[ended[inner]]
        if len(ended) or i % 8 == 7:
            keep = (sizes[:, 0] > i) & (row.min(1) <= most)
            row, a, b, sizes, most, live = row[keep], a[keep], b[keep], sizes[keep], most[keep], live[keep]
            if not len(live):
                break
        last = row
    return out


def _may_meet(front: Front, s: Segments, similarity: float) -> Segments:
    """The segments whose length allows for a pair with one of ``front``, with their folded bytes only."""

    def fits(ranked: np.ndarray) -> np.ndarray:
        if not len(ranked):
            return np.zeros(len(s), bool)
        k = np.searchsorted(ranked, s.size)
        ends = ranked[np.minimum(k, len(ranked) - 1)], ranked[np.maximum(k - 1, 0)]
        return np.logical_or.reduce([np.abs(s.size - x) <= _within_reach(s.size, x, similarity) for x in ends])

    at = np.flatnonzero(fits(np.unique(front.size[~front.field])) | (s.marked & fits(np.unique(front.size[front.field]))))
    if len(at) == len(s):
        return s
    size = s.last[at] - s.first[at]
    first = np.cumsum(size + 2) - size - 1
    parts = {k: getattr(s, k)[at] for k in ("owner", "start", "end", "n_words", "size", "marked", "suspect")}
    return Segments(raw=s.raw, plain=np.r_[s.plain[_spans(size + 2, s.first[at] - 1)], np.uint8(32)], first=first, last=first + size, **parts)


def _linked(front: Front, s: Segments, told: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(identities of all segments; segment and group of each link): the segments that a pair links to each group.
    Candidates of a group are compared from the nearest on, until one is similar enough."""
    node, print_, least = _measured(s)
    keys = np.concatenate([_keys(least, s.size, i) for i in (-1, 0, 1)], axis=1)
    i, j = _met(front, node, print_, s.size, s.marked, keys, _among(node, told)[0], similarity, MAX_DISTANCE)
    if len(i):
        some, row = np.unique(i, return_inverse=True)
        bags = _bags(s, some).astype(np.int16)
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), PAIRS // 16):
            part = slice(k, k + PAIRS // 16)
            more = bags[row[part]] - front.bag[j[part]]
            least_edits = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
            keep[part] = least_edits <= _within_reach(s.size[i[part]], front.size[j[part]], similarity)
        # Both ends in one group: they are linked already.
        own, place = _among(node[i], np.sort(front.node))
        keep &= ~(own & (front.group[np.argsort(front.node, kind="stable")[place]] == front.group[j]))
        i, j = i[keep], j[keep]
    group = front.group[j]
    order = np.lexsort((np.bitwise_count(print_[i] ^ front.print[j]), group, i))
    i, j, group = i[order], j[order], group[order]
    begin = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (group[1:] != group[:-1])]) if len(i) else i
    at, end, found, left, step = begin.copy(), np.r_[begin[1:], len(i)], np.zeros(len(begin), bool), np.arange(len(begin)), 1
    texts: dict[int, str] = {}
    while len(left):
        n = np.minimum(step, end[left] - at[left])
        pairs, of = _spans(n, at[left]), np.repeat(left, n)
        for k in np.unique(i[pairs]).tolist():
            texts[k] = texts.get(k) or s.text(k)
        good = alike([texts[k] for k in i[pairs].tolist()], front.texts.take(pa.array(j[pairs])).to_pylist(), similarity)
        found[of[good]] = True
        at[left] += n
        left, step = left[~found[left] & (at[left] < end[left])], min(2 * step, 1024)
    return node, i[begin[found]], group[begin[found]]


def _among(values: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among ranked ones, and its place."""
    if not len(ranked):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return ranked[place] == values, place


def neighbours(df: DataFrame, id_col: str, text_col: str, front: Front, told: np.ndarray, similarity: float) -> DataFrame:
    """(id, total, node, n_words, text, groups) of every segment of every document, but for the identities ``told``, that a
    pair links to a segment of ``front``; ``groups``: those it is linked to."""
    sent = df.sparkSession.sparkContext.broadcast((front, told))
    names = [id_col, "total", *_ROWS[1:], "text", "groups"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, told = sent.value
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                s = segments(texts)
                totals = np.bincount(s.owner, s.n_words, len(texts)).astype(np.int64)
                s = _may_meet(front, s, similarity)
                node, linked, groups = _linked(front, s, told, similarity) if len(s) else (None, [], None)
                if not len(linked):
                    continue
                at, begin = np.unique(linked, return_index=True)
                total = totals[s.owner[at]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(groups)].astype(np.int32)), pa.array(groups))
                columns = [pa.array(total), pa.array(node[at].view(np.int64)), pa.array(s.n_words[at].astype(np.int32)), pa.array([s.text(k) for k in at.tolist()]), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.owner[at] + first)), *columns], names)

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(id_col, text_col).where(F.col(text_col).isNotNull())
    return found.mapInArrow(find, f"`{id_col}` {kind}, total bigint, node bigint, n_words int, text string, groups array<bigint>")


def keyed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, text, kind) with SimHash and the keys of their texts on their level of length and the next ones."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = segments([x.encode("utf-8", "replace") for x in batch.column(1).to_pylist()], sentences=False)
                _, print_, least = _measured(s)
                keys = np.concatenate([_keys(least, s.size, i) for i in (-1, 0, 1)], axis=1).astype(np.int64)
                columns = [pa.array(print_.view(np.int64)), pa.array(s.size.astype(np.int32)), pa.array(keys.tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["node", "text", "kind", "print", "size", "keys"])

    return nodes.select("node", "text", "kind").mapInArrow(find, "node bigint, text string, kind string, print bigint, size int, keys array<bigint>")


def meetings(left: DataFrame, right: DataFrame, similarity: float, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(node, node2) that share a key, whose SimHashes are within ``max_distance`` and whose lengths allow for the
    similarity (``_met`` for tables). ``left``: node, text, kind, print, size, keys (around), held by every task; ``right``:
    node, marked, print, size, keys."""
    table = left.select("node", "text", "kind", F.col("node").alias("group"), "print", "size", "keys").toArrow()
    arrays = [table.column(c).to_numpy() for c in ("print", "size")]
    keys = np.array(table.column("keys").to_pylist(), np.int64).astype(np.uint32)
    front = _front(table, arrays[0].view(np.uint64), arrays[1].astype(np.int64), np.zeros((0, 32), np.uint8), keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, print_, size = (batch.column(k).to_numpy() for k in range(3))
                keys = np.array(batch.column(4).to_pylist(), np.int64).astype(np.uint32)
                marked = batch.column(3).to_numpy(zero_copy_only=False)
                i, j = _met(front, node.view(np.uint64), print_.view(np.uint64), size.astype(np.int64), marked, keys, np.zeros(len(node), bool), similarity, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(front.node[j].view(np.int64)), pa.array(node[i])], ["node", "node2"])

    return right.select("node", "print", "size", "marked", "keys").mapInArrow(find, "node bigint, node2 bigint").distinct()


def near_pairs(met: DataFrame, left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """(node, node2) of the pairs ``met`` whose texts are similar enough. ``left``, ``right``: node, text."""
    both = met.join(left.select("node", "text"), "node").join(right.select(F.col("node").alias("node2"), F.col("text").alias("text2")), "node2")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["node", "node2"]).filter(pa.array(alike(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)))

    return both.select("node", "node2", "text", "text2").mapInArrow(find, "node bigint, node2 bigint")


_ROWS = ("total", "node", "n_words")


def reached(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame] | None:
    """(rows, edges): (id, total, node, n_words) of the open segments that pairs link, over any number of
    steps, to trusted residue, and links (a, b) that tell their components; None if there are none.

    All segments of all documents are searched; each step asks for the neighbours of the segments found
    by the last one, SLICE at a time. ``nodes``: node, text, label, kind of the trusted segments.
    Pairs of two segments with a trusted label tell nothing and are not made, so families of variants
    of one notice do not meet among themselves; open segments meet all but trusted residue, as those
    that speak about it bar them. Segments that were found from one group are linked with one another, so
    a step looks for one link of a segment to each group, not for all pairs.
    """
    ids = lambda x: np.sort(x.select("node").toArrow().column(0).to_numpy().view(np.uint64))
    told, residue_only = ids(nodes), ids(nodes.where("label = 1"))
    known, rows, edges = nodes.select("node"), None, None
    front = nodes.where("label = 1").select("node", "text", "kind", F.col("node").alias("group"))
    while (n := front.count()) > 0:
        new, parts = None, -(-n // SLICE)
        for part in range(parts):
            asked = front.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == part)
            if asked.isEmpty():
                continue
            some = front_of(asked)
            found = cut(neighbours(df, id_col, text_col, some, told, similarity))
            if found.isEmpty():
                continue
            links = found.select(F.explode("groups").alias("a"), F.col("node").alias("b")).distinct()
            edges = links if edges is None else edges.union(links)
            fresh = cut(found.groupBy("node").agg(F.first("text").alias("text"), F.min(F.array_min("groups")).alias("group")).join(known, "node", "left_anti"))
            own = found.join(fresh.select("node"), "node", "left_semi").select(id_col, *_ROWS)
            rows = own if rows is None else rows.union(own)
            known = known.union(fresh.select("node"))
            new = fresh if new is None else new.union(fresh)
        if new is None:
            break
        front, told = new.select("node", "text", F.lit("").alias("kind"), "group"), residue_only
    return None if edges is None else (rows, edges)


def spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, spread_label, spread_kind) of the open nodes in a component with trusted residue. A
    component that also holds a segment speaking about residue gives no label.

    ``nodes``: node, label, kind; one row per distinct segment, open ones may be missing.
    """
    parts = connected_components(edges).withColumnRenamed("id", "node")
    labelled = parts.join(nodes.select("node", "label", "kind"), "node", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    told = labelled.groupBy("component").agg(F.max("label").alias("most"), F.min("label").alias("least"), F.max(F.when(F.col("label") == 1, F.col("kind"))).alias("spread_kind"))
    given = told.where("most = 1 and least = 0").select("component", "spread_kind")
    return labelled.where("label = 0").join(given, "component").select("node", F.lit(1).alias("spread_label"), "spread_kind")


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spreading: bool = True) -> DataFrame:
    """(id, reason) of every document with residue; reason is field, notice or filler.

    ``spreading``: whether labels spread to near copies of trusted segments.
    """
    scan = scanned(df, id_col, text_col)
    rows = cut(scan.select(id_col, "total", F.explode("trusted").alias("s")).select(id_col, "total", "s.*"))
    nodes = cut(rows.groupBy("node").agg(F.first("text").alias("text"), F.max("label").alias("label"), F.max("kind").alias("kind")))
    told = rows.select(id_col, *_ROWS, "label", "kind")
    more = reached(df, id_col, text_col, nodes) if spreading else None
    if more is not None:
        opened = more[0].join(spread(nodes, more[1]), "node")
        told = told.union(opened.select(id_col, *_ROWS, "spread_label", "spread_kind"))
    hit = F.col("label") == 1
    per_doc = told.groupBy(id_col).agg(
        F.max(hit & (F.col("kind") == "field")).alias("field"),
        F.max(hit & (F.col("kind") == "notice")).alias("notice"),
        F.sum(F.when(hit & F.col("kind").isin("filler", "field"), F.col("n_words")).otherwise(0)).alias("filler"),
        F.max("total").alias("total"),
    )
    reason = F.when(F.col("field"), "field").when(F.col("notice"), "notice").when(F.col("filler") >= 0.5 * F.col("total"), "filler")
    return per_doc.select(id_col, reason.alias("reason")).where("reason is not null")
