"""Layout-aware rendering of HTML: the visible text with its block spacing, lists and tables.

The tree builder supplies implied tags; visibility rules leave out what a browser would not
show (and, for the main body, navigation, headers, footers and asides). Blocks start new lines,
headings and paragraphs are set apart by a blank line, list items get their mark, the cells of
a table are padded to columns, and preformatted text keeps its blanks.

Null and empty content renders as empty text; content that is no HTML is rendered as it would
be by a browser, as one block.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.html import HIDDEN_ROLES, Node, decoded, parsed

NEVER = frozenset("script style template head title meta noscript svg iframe object select datalist".split())
FURNITURE = frozenset("nav header footer aside".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure article section main form fieldset address hr".split())
LINES = frozenset("div li dt dd tr caption figcaption legend option body html details summary header footer nav aside".split())
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hidden(node: Node, main_only: bool) -> bool:
    a = node.attrs
    if node.tag in NEVER or "hidden" in a or a.get("aria-hidden") == "true" or _HIDES.search(a.get("style", "")):
        return True
    return main_only and (node.tag in FURNITURE or a.get("role") in HIDDEN_ROLES)


class _Sheet:
    """Lines of text; blank lines between blocks never pile up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.mark = ""
        self.raw = False

    def text(self, data: str, keep: bool) -> None:
        if keep:
            self.raw = True
            first, *rest = data.split("\n")
            self.line.append(first)
            for part in rest:
                self.end(keep=True)
                self.raw = True
                self.line.append(part)
        elif data.strip():
            if self.line and (data[0].isspace() or self.line[-1].endswith(" ")):
                self.line[-1] = self.line[-1].rstrip() + " "
            self.line.append(" ".join(data.split()) + (" " if data[-1].isspace() else ""))
        elif data and self.line and not self.line[-1].endswith(" "):
            self.line[-1] += " "

    def end(self, keep: bool = False) -> None:
        line = "".join(self.line)
        line = line.rstrip() if self.raw else line.strip()
        if line:
            self.lines.append(self.mark + line)
            self.mark = " " * len(self.mark)
        elif keep and self.lines and self.lines[-1]:
            self.lines.append("")
        self.line, self.raw = [], False

    def gap(self) -> None:
        self.end()
        if self.lines and self.lines[-1]:
            self.lines.append("")


def _cells(row: Node) -> list[Node]:
    return [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]


def _table(node: Node, main_only: bool) -> list[str]:
    rows, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.tag == "tr":
            rows.append([" ".join(render_node(c, main_only).split()) for c in _cells(n) if not hidden(c, main_only)])
        else:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not hidden(c, main_only) and c.tag in ("tr", "thead", "tbody", "tfoot"))
    width = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    return ["  ".join(c.ljust(width[i]) for i, c in enumerate(r)).rstrip() for r in rows if any(r)]


def render_node(root: Node, main_only: bool = False) -> str:
    sheet, pre = _Sheet(), 0
    stack: list[tuple[object, bool]] = [(root, False)]
    numbers: list[int] = []
    while stack:
        node, leaving = stack.pop()
        if node is None:
            continue
        if isinstance(node, str):
            sheet.text(node, pre > 0)
            continue
        if leaving:
            pre -= node.tag == "pre"
            if node.tag in ("ul", "ol"):
                numbers.pop()
            (sheet.gap if node.tag in APART and len(numbers) < 1 else sheet.end)()
            if node.tag == "li":
                sheet.mark = ""
            continue
        if node is not root and hidden(node, main_only):
            continue
        if node.tag == "br":
            sheet.end()
            continue
        if node.tag == "table" and node is not root:
            sheet.gap()
            sheet.lines.extend(_table(node, main_only))
            sheet.gap()
            continue
        if node.tag in APART and not numbers:
            sheet.gap()
        elif node.tag in APART or node.tag in LINES:
            sheet.end()
        if node.tag in ("ul", "ol"):
            numbers.append(0 if node.tag == "ol" else -1)
        if node.tag == "li":
            indent = "  " * max(0, len(numbers) - 1)
            if numbers and numbers[-1] >= 0:
                numbers[-1] += 1
                sheet.mark = f"{indent}{numbers[-1]}. "
            else:
                sheet.mark = f"{indent}- "
        pre += node.tag == "pre"
        if node.tag in APART or node.tag in LINES:
            stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    sheet.end()
    return "\n".join(sheet.lines).strip("\n")


def render(content: bytes | str | None, main_only: bool = False) -> str:
    return render_node(parsed(decoded(content)), main_only) if content else ""


def rendered(df: DataFrame, id_col: str, content: str, main_only: bool = False) -> DataFrame:
    """(id, text) of every row's HTML."""

    @F.pandas_udf(T.StringType())
    def page(contents: pd.Series) -> pd.Series:
        return pd.Series([render(c, main_only) for c in contents], dtype=object)

    return df.select(id_col, page(F.col(content)).alias("text"))
