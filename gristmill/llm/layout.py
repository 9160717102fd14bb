"""Problem 6: the main body of a page, by building its layout and hiding what is furniture.

Two inputs share the idea. HTML (`render`): a tree builder with implied tags and visibility
rules emits the visible text with block spacing, list marks and aligned table cells. Text that
was already rendered (`furniture_lines`): the lines are read back into blocks with implied
roles (menu, path, notice, teaser list, sharing bar, footer; headline and article), a block
being closed by the first line that cannot belong to it, and the visibility rules drop every
block that is not the article's.

Evidence from the corpus joins in: labels that stand alone on pages of several sites are menu
entries, and short lines that open many pages of one site are its name. Null and blank texts
have no lines to drop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.site import site
from gristmill.runtime import cut

_DIGITS = re.compile("[0-9]+")
_LABEL = re.compile(r"[^\W\d_][^\d_.,;:!?()|]{1,23}$")
MARKER = re.compile(r"^(?:[-*•›»>·–|]\s+|\d{1,2}[.)]\s+)+")
#: Openings of furniture lines, whatever follows.
OPENING = re.compile(
    r"(?:skip (?:to|navigation)|jump to\b|toggle (?:menu|navigation)|« ?back\b|‹ ?back\b|back to (?:top|\w+(?: \w+)?$)|you are here\b|print (?:this|version|page)|send (?:by|this)|e-?mail this|share (?:this|on|via)"
    r"|shared \d+|tell a friend|like what you read|follow us|subscribe to|sign up (?:for|to)|never miss|join (?:our|the) (?:mailing|newsletter)|support \w+.{0,40}: donate|donate\b|article continues|story continues|read (?:also|more|next)\b"
    r"|see also:|tags?\s*:|filed under|categor(?:y|ies)\s*:|keywords?\s*:|previous\s*:|next\s*:|last (?:modified|changed?|updated?|edited|reviewed)|page (?:updated|last|created)|updated (?:on )?\d|copyright\b|©|\(c\) \d{4}|terms of (?:use|service)"
    r"|privacy (?:policy|notice)|no part of this site|the views on this page|we and our partners|your choice about cookies|this (?:web)?site (?:keeps|uses|stores)|to give you a better|by using this|accept (?:all|cookies)"
    r"|log ?in\b.{0,25}$|register\b.{0,12}$|leave a (?:comment|reply)|\d+ comments?$|comments? \(\d+\)|powered by|site by|designed by)",
    re.I,
)
#: Phrases that make a line furniture wherever they stand in it.
PHRASE = re.compile(
    r"uses cookies|all rights reserved|without (?:the )?(?:written|prior) consent|is an equal opportunity|is provided as is|without warranty|remembers your preferences|reflect those of|cookies? settings"
    r"|found this useful|was (?:it|this) (?:\w+ )?(?:useful|helpful) to you|desk is closed|rate this|\d+ views\b"
    r"|phone[: ]+\+?[\d(][\d() -]{4,}$|terms of use \||\| *privacy|privacy *\||pass it on|by webmaster",
    re.I,
)
WHOLE = re.compile(r"\W*(?:menu|navigation|search(?: \w+)?|advertis(?:e)?ments?|sponsored(?: content)?|ad|ok|close|share|print|top|more|login|print this page|send by e-mail)\W*$", re.I)
#: Headings that open a list of teasers.
ASIDE = re.compile(
    r"\W*(?:most (?:read|popular|viewed)|related (?:articles|posts|stories|links|pages)|recent (?:posts|articles|comments|news)|you (?:may|might) also like|more (?:from|in|on) (?:this|the) \w+|quick ?links|popular (?:posts|articles)"
    r"|latest (?:posts|news|articles)|further reading|editor'?s picks|recommended(?: for you)?|trending(?: now)?|see also|what to read next|in this section|more stories)\W*$",
    re.I,
)
#: Entries of site menus.
MENU = frozenset(
    "home|about|about us|contact|contact us|news|events|people|faculty|staff|students|research|projects|publications|courses|calendar|seminars|jobs|careers|library|help|faq|search|site map|sitemap|directory|maps|map|log in|login|my account|"
    "intranet|wiki|software|software store|downloads|forms|policies|awards|alumni|giving|outreach|partners|photos|gallery|facilities|admissions|undergraduate|graduate|blog|archive|press|media|resources|services|support|overview|academics|"
    "departments|programs|teaching|links|shop|store|subscribe|newsletter|register|imprint|accessibility|privacy".split("|")
)
BYLINE = re.compile(r"(?:by|written by|posted by|von|par|por)\s+\S+|.{3,60},? (?:staff |senior |guest |freelance )?(?:writer|reporter|correspondent|columnist|editor)$", re.I)
DATELINE = re.compile(r"^\w+day,? .*\d|^\w+day,? \w+ \d|^\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|^\d{4}-\d\d-\d\d\b|^(?:\d{1,2} )?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w* \d", re.I)
#: Forms that articles repeat: items of lists, figures, code, table rows.
ITEM = re.compile(r"\bno\.? \d+|\d+ x |\(\d+\)|, \d+ pcs|^figure \d|^table \d|[;{}]$|[{}]|^#define|\breturn\b|^\S+[,|;\t]|\s[|]\s|\t", re.I)
MINUTES = re.compile(r"\(\d+ min(?:ute)?s? read\)\s*$", re.I)
CRUMB = re.compile(r"^(?:you are here:? *)?(?P<path>[^.!?]{1,80}?(?: *(?:>|›|»|::) *[^.!?>›»]{1,80})+|you are here.*)$", re.I)


def parts_of_menu(line: str, menu: frozenset[str]) -> bool:
    """Whether the line is nothing but menu entries, in a row or parted by signs or blanks."""
    low = " ".join(line.lower().split())
    if low in menu:
        return True
    parts = [p for p in re.split(r"\s*[|·•/»>]\s*|\s{2,}", line.lower().strip()) if p]
    if len(parts) > 1 and sum(p in menu for p in parts) >= 0.7 * len(parts):
        return True
    words, i, n = low.split(), 0, 0
    if len(words) < 3:
        return False
    while i < len(words):
        for k in (3, 2, 1):
            if " ".join(words[i : i + k]) in menu:
                i, n = i + k, n + 1
                break
        else:
            return False
    return n >= 3


def title_like(line: str) -> bool:
    """A line that may be a headline or a teaser: short, and no sentence or item of a list."""
    words = line.split()
    if MINUTES.search(line) or line.endswith(("...", "…")):
        return True
    return 1 < len(words) <= 14 and line[-1] not in ".!?;,:{}" and not ITEM.search(re.sub(r"\((?:\d+ min read)\)", "", line)) and any(map(str.isalpha, line))


def furniture(text: str, host: str | None, menu: frozenset[str], doubtful: list | None = None) -> list[int]:
    """Numbers of the lines that are not of the article.

    ``doubtful`` takes (number, folded line, kind) of other short lines: kind "name" of those
    before the article's first sentence, any of which may be the name of the site, and kind
    "label" of those of up to three plain words, which may be menu entries.
    """
    out: list[int] = []
    name = None
    if host:
        labels = [x for x in host.split(".") if len(x) > 2]
        name = labels[0] if labels else None
    aside: list[int] | None = None  # lines of the open teaser list
    headline = waiting = False
    early = doubtful is not None
    crumb_title = None
    for i, raw in enumerate(text.split("\n")):
        line = raw.strip()
        if not line:
            continue
        bare = MARKER.sub("", line)
        low = " ".join(bare.lower().split())
        words = low.split()
        kind = ""
        if ASIDE.match(bare):
            kind = "aside"
        elif OPENING.match(low) or PHRASE.search(low) or WHOLE.match(low):
            kind = "furniture"
            if low.startswith("you are here"):
                crumb_title = re.split(r"\s*[>/›»:]+\s*", low)[-1]
        elif parts_of_menu(bare, menu):
            kind = "furniture"
        elif m := CRUMB.match(bare):
            first = re.split(r"\s*(?:>|›|»|::)\s*", m["path"])[0].strip().lower()
            if first in menu:
                kind = "furniture"
                crumb_title = re.split(r"\s*(?:>|›|»|::)\s*", low)[-1]
        elif name and len(words) <= 4 and name in words and not headline and not BYLINE.match(low):
            kind = "furniture"
        if crumb_title in menu:
            crumb_title = None
        if kind:
            waiting = False
        if kind == "furniture":
            if aside:
                aside = None
            out.append(i)
            continue
        if kind == "aside":
            aside = [i]
            out.append(i)
            continue
        if aside is not None and title_like(bare) and low != crumb_title and not BYLINE.match(low):
            aside.append(i)
            out.append(i)
            continue
        if aside is not None:
            # The list is closed; before an article without headline its last title is the headline.
            if not headline and len(aside) > 1 and low != crumb_title and not MINUTES.search(text.split("\n")[aside[-1]]):
                if not text.split("\n")[aside[-1]].rstrip().endswith(("...", "…")) and (BYLINE.match(low) or DATELINE.match(low) or len(words) > 8):
                    out.remove(aside[-1])
            aside = None
        # A headline is followed by more of its article, the name of a site by furniture.
        headline = headline or waiting or len(words) > 8
        waiting = True
        if doubtful is not None and len(words) <= 3 and _LABEL.match(low) and not BYLINE.match(low):
            doubtful.append((i, low, "label"))
        if early:
            if BYLINE.match(low) or DATELINE.match(low) or len(words) > 8:
                early = False
            elif len(words) <= 6 and not ITEM.search(bare):
                doubtful.append((i, _DIGITS.sub("0", low), "name"))
    return sorted(out)


def furniture_lines(
    df: DataFrame,
    id_col: str = "log_id",
    text_col: str = "text",
    url_col: str = "fetch_url",
    min_sites: int = 8,
    min_rows: int = 12,
    min_docs: int = 5,
    min_share: float = 0.02,
) -> DataFrame:
    """(id, line_no) of the non-blank lines that are not part of the page's article.

    A short line before the article that stands there on at least ``min_docs`` pages and
    ``min_share`` of the pages of its site is the site's name. A label of up to three words on
    ``min_rows`` pages of ``min_sites`` sites is a menu entry.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, numbers, keys, kinds, texts = [], [], [], [], batch.column(2).to_pylist()
            for row, (host, text) in enumerate(zip(batch.column(1).to_pylist(), texts, strict=True)):
                doubtful: list[tuple[int, str, str]] = []
                found = furniture(text, host, MENU, doubtful)
                both = [(i, None, None) for i in found] + (doubtful if host else [])
                owner.extend([row] * len(both))
                numbers.extend(x[0] for x in both)
                keys.extend(x[1] for x in both)
                kinds.extend(x[2] for x in both)
            if owner:
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(keys, pa.string()), pa.array(kinds, pa.string())],
                    [id_col, "_site", "line_no", "_key", "_kind"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.withColumn("_site", site(F.col(url_col)))
    rows = keyed.where(F.trim(F.col(text_col)) != "").select(id_col, "_site", text_col)
    lines = cut(rows.mapInArrow(find, f"`{id_col}` {kind}, _site string, line_no int, _key string, _kind string"))
    sizes = keyed.where("_site is not null").groupBy("_site").agg(F.count("*").alias("_pages"))
    per_site = lines.where("_key is not null").groupBy("_kind", "_site", "_key").agg(F.count("*").alias("_n"))
    names = per_site.where((F.col("_kind") == "name") & (F.col("_n") >= min_docs)).join(sizes, "_site")
    names = names.where(F.col("_n") >= min_share * F.col("_pages")).select("_site", "_key")
    labels = per_site.where("_kind = 'label'").groupBy("_key").agg(F.count("*").alias("_sites"), F.sum("_n").alias("_rows"))
    labels = labels.where((F.col("_sites") >= min_sites) & (F.col("_rows") >= min_rows)).select("_key")
    of_name = lines.where("_kind = 'name'").join(names, ["_site", "_key"], "left_semi")
    of_label = lines.where("_kind = 'label'").join(labels, "_key", "left_semi")
    more = of_name.select(id_col, "line_no").union(of_label.select(id_col, "line_no")).distinct()
    return lines.where("_key is null").select(id_col, "line_no").union(more)
