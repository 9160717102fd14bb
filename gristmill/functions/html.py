"""HTML: a small tree builder on the standard parser, links and visible text from it.

The builder knows void and raw-text elements, closes ``p``, ``li``, ``td``, ``option`` and their
like where the next tag implies it, and lets a stray end tag close up to its element. Recovery
from broken markup may differ from other parsers in detail; text and links are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element of the key is closed by a start tag of the value, within its container.
IMPLIED = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]) | BLOCKS | frozenset(["a", "ul", "li"]),
}
SCOPES = frozenset(["table", "ul", "ol", "dl", "select", "html", "body", "div", "section", "article"])
#: Elements and roles that are never visible text.
HIDDEN_TAGS = frozenset("script style head meta title noscript nav header footer aside".split())
HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """Elements in document order, without recursion: pages nest deeply."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.open) > 1:
            for i in range(len(self.open) - 1, 0, -1):
                above = self.open[i].tag
                if tag in IMPLIED.get(above, ()):
                    del self.open[i:]
                    break
                if above in SCOPES:
                    i = 0
                    break
            else:
                i = 0
            if i == 0:
                break
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        node = Node(tag, named)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(None)  # parts the text around it


def decoded(content: bytes | str | None) -> str:
    """UTF-8, or Latin-1 where that fails; null is empty. Of UTF-16 pages the zero bytes stay, so
    they don't look like HTML, but their links are found, as the parser drops them."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    content = bytes(content)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parsed(html: str) -> Node:
    builder = _Builder()
    builder.feed(html.replace("\x00", ""))
    builder.close()
    return builder.root


def looks_like_html(content: bytes | str | None) -> bool:
    if not content:
        return False
    head = content[:8192] if isinstance(content, str) else bytes(content[:8192]).decode("utf-8", "ignore")
    head = head.lower()
    return "<html" in head or "<body" in head or "<!doctype" in head


def link_candidates(root: Node, url: str) -> list[str]:
    """Absolute targets: anchors and areas in document order, then frames, then canonical links."""
    base, found = url, ([], [], [])
    first = next((n for n in root.walk() if n.tag == "base" and "href" in n.attrs), None)
    if first is not None and first.attrs["href"].strip():
        try:
            base = urljoin(url, first.attrs["href"].strip())
        except ValueError:
            pass
    for n in root.walk():
        if n.tag in ("a", "area"):
            found[0].append(n.attrs.get("href"))
        elif n.tag == "iframe":
            found[1].append(n.attrs.get("src"))
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").split():
            found[2].append(n.attrs.get("href"))
    out = []
    for target in (t.strip() for group in found for t in group if t):
        if target:
            try:
                out.append(urljoin(base, target))
            except ValueError:
                continue
    return out


def visible_text(root: Node) -> str:
    """Stripped text nodes outside hidden elements and roles, one per line."""
    lines, buffer = [], []

    def flush() -> None:
        if text := "".join(buffer).strip():
            lines.append(text)
        buffer.clear()

    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            buffer.append(node)
            continue
        flush()
        if node is None or node.tag in HIDDEN_TAGS or node.attrs.get("role") in HIDDEN_ROLES:
            continue
        stack.append(None)
        stack.extend(reversed(node.children))
    flush()
    return "\n".join(lines)


PAGE = T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])


@F.pandas_udf(PAGE)
def page(contents: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """Link candidates (not yet normalised) and visible text of each page; the text of content
    that does not look like HTML is empty. Null content has no links and empty text."""
    rows = []
    for content, url in zip(contents, urls, strict=True):
        root = parsed(decoded(content))
        rows.append((link_candidates(root, url or ""), visible_text(root) if looks_like_html(content) else ""))
    return pd.DataFrame(rows, columns=["links", "text"])


@F.pandas_udf(T.StringType())
def resolve(bases: pd.Series, targets: pd.Series) -> pd.Series:
    """``urljoin``; null where either is null or the target is malformed."""
    out = []
    for base, target in zip(bases, targets, strict=True):
        try:
            out.append(None if base is None or target is None else urljoin(base, target))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)
