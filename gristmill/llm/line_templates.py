"""Problem 1: lines repeated across one site's documents.

Lines are parsed into templates: letter case and white space are folded and each run of
digits becomes a wildcard slot. Each partition grows trees of fixed depth (site, number of
tokens, first tokens; a leaf is a full template) and counts documents at the leaves; equal
leaves of all partitions are merged. Templates that cover enough of a site's documents are
joined back to the lines, and can be removed from the texts.

Null or blank texts hold no lines but count as documents of their site; rows without a site
hold no cases; a line without a letter is never a template; lines repeated within a document
count once for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.site import site

SLOT = "0"
_DIGITS = re.compile("[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
#: A partition's trees are handed on when they hold so many leaves.
MAX_LEAVES = 250_000

LEAF = "leaf_a bigint, leaf_b bigint"
TREE = f"_site string, n_tokens int, branch bigint, {LEAF}, n int"


def template_tokens(text: str) -> Iterator[tuple[int, list[str]]]:
    """Line number and template tokens of each line with a letter."""
    for i, line in enumerate(_DIGITS.sub(SLOT, text.lower()).split("\n")):
        if _LETTER.search(line):
            yield i, line.split()


def leaf_key(tokens: list[str]) -> bytes:
    """128-bit key of a template, so that no shuffle carries text."""
    return xxhash.xxh3_128_digest(" ".join(tokens).encode())


def _keys(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(pairs[:, 0]), pa.array(pairs[:, 1])


def trees(docs: DataFrame, depth: int) -> DataFrame:
    """Leaves of the trees of each partition (of pieces of it where it is large), with the
    number of documents of each."""

    def rows(tree: dict) -> pa.RecordBatch:
        flat = [
            (s, n, branch, leaf, count)
            for s, by_length in tree.items()
            for n, branches in by_length.items()
            for branch, leaves in branches.items()
            for leaf, count in leaves.items()
        ]
        sites, lengths, branches, leaves, counts = zip(*flat, strict=True)
        firsts = [int.from_bytes(xxhash.xxh3_64_digest(b.encode()), "little", signed=True) for b in branches]
        return pa.RecordBatch.from_arrays(
            [pa.array(sites), pa.array(lengths, pa.int32()), pa.array(firsts, pa.int64()), *_keys(leaves), pa.array(counts, pa.int32())],
            ["_site", "n_tokens", "branch", "leaf_a", "leaf_b", "n"],
        )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: dict[str, dict[int, dict[str, dict[bytes, int]]]] = {}
        held = 0
        for batch in batches:
            for host, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen = {}
                for _, tokens in template_tokens(text):
                    seen.setdefault(leaf_key(tokens), tokens)
                by_length = tree.setdefault(host, {})
                for key, tokens in seen.items():
                    leaves = by_length.setdefault(len(tokens), {}).setdefault(" ".join(tokens[:depth]), {})
                    leaves[key] = leaves.get(key, 0) + 1
                held += len(seen)
                if held > MAX_LEAVES:
                    yield rows(tree)
                    tree, held = {}, 0
        if held:
            yield rows(tree)

    return docs.mapInArrow(grow, TREE)


def keyed_lines(docs: DataFrame, id_type: str) -> DataFrame:
    """(_id, _site, line_no, leaf) of every line with a letter."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, numbers, digests = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for i, tokens in template_tokens(text):
                    owner.append(row)
                    numbers.append(i)
                    digests.append(leaf_key(tokens))
            if owner:
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), *_keys(digests)],
                    ["_id", "_site", "line_no", "leaf_a", "leaf_b"],
                )

    return docs.mapInArrow(parse, f"_id {id_type}, _site string, line_no int, {LEAF}")


def repeated_lines(
    df: DataFrame,
    id_col: str = "log_id",
    text_col: str = "text",
    url_col: str = "fetch_url",
    min_docs: int = 5,
    min_share: float = 0.02,
    depth: int = 3,
) -> DataFrame:
    """(id, line_no) of every line whose template is frequent in its site; ``id_col`` is unique.

    Lines meet the frequent templates by an equality join: Spark broadcasts the templates
    only below its checked threshold, and splits the partitions of a hot site otherwise.
    """
    keyed = df.withColumn("_site", site(F.col(url_col))).where("_site is not null")
    sizes = keyed.groupBy("_site").agg(F.count("*").alias("site_docs"))
    docs = keyed.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), "_site", text_col)
    path = ["_site", "n_tokens", "branch", "leaf_a", "leaf_b"]
    merged = trees(docs, depth).groupBy(*path).agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    frequent = merged.join(sizes, "_site").where(F.col("n_docs") >= min_share * F.col("site_docs"))
    keys = ["_site", "leaf_a", "leaf_b"]
    lines = keyed_lines(docs, df.schema[id_col].dataType.simpleString())
    return lines.join(frequent.select(*keys), keys).select(F.col("_id").alias(id_col), "line_no")


def without_repeated_lines(df: DataFrame, id_col: str = "log_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with ``text_clean``: the text without its repeated lines, and ``n_removed``.

    A null text stays null; a text all of whose lines are repeated becomes empty.
    """
    found = repeated_lines(df, id_col, text_col, **how)
    drop = found.groupBy(id_col).agg(F.collect_list("line_no").alias("_drop"))
    joined = df.join(drop, id_col, "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<int>")))
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(F.col("_drop"), i.cast("int")))
    return joined.withColumn("text_clean", F.array_join(kept, "\n")).withColumn("n_removed", F.size("_drop")).drop("_drop")
