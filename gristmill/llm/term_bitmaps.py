"""Problem 2: frequency of every distinct term, in a vertical layout.

Each term holds compressed bitmaps of record identifiers beside a parallel occurrence
counter. The id space is cut into blocks of 65,536; the bitmap of a block is either a sorted
array of 16-bit offsets or, from 4,096 offsets on, 8 KiB of bits. Partitions build their own
bitmaps, equal (term, block) keys are merged by union, and the document frequency of a term
is the cardinality of its blocks. A group is bounded by its block, so no term is too hot.

A null or empty text holds no terms but its row counts in the total. Rows of equal id are
one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = r"[a-z]+(?:'[a-z]+)?"
BLOCK_BITS = 16
DENSE = 4096


def pack(offsets: np.ndarray) -> bytes:
    """A block's distinct sorted offsets as an array or, when dense, as bits (told by the length)."""
    if len(offsets) < DENSE:
        return offsets.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, np.bool_)
    bits[offsets] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(block: bytes) -> np.ndarray:
    if len(block) == 1 << (BLOCK_BITS - 3):
        return np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8), bitorder="little"))
    return np.frombuffer(block, "<u2").astype(np.int64)


def union(blocks: list[bytes]) -> bytes:
    return blocks[0] if len(blocks) == 1 else pack(np.unique(np.concatenate([unpack(b) for b in blocks])))


def cardinality(block: bytes) -> int:
    return len(unpack(block)) if len(block) == 1 << (BLOCK_BITS - 3) else len(block) // 2


SCHEMA = pa.schema([("term", pa.string()), ("block", pa.int64()), ("bitmap", pa.binary()), ("n", pa.int64())])


def _vertical(texts: list, ids: np.ndarray, find) -> pa.RecordBatch:
    words: dict[str, int] = {}
    codes, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = find(text.lower())
            lengths[i] = len(found)
            codes.extend([words.setdefault(w, len(words)) for w in found])
    owner = np.repeat(ids, lengths)
    code = np.array(codes, np.int64)
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    block = owner >> BLOCK_BITS
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]) if len(code) else np.array([], np.int64)
    ends = np.r_[starts[1:], len(code)] if len(starts) else starts
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])] if len(code) else np.array([], bool)
    low = owner & ((1 << BLOCK_BITS) - 1)
    names = np.array(list(words), object)
    bitmaps = [pack(low[a:b][fresh[a:b]]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names[code[starts]] if len(starts) else [], pa.string()),
            pa.array(block[starts]),
            pa.array(bitmaps, pa.binary()),
            pa.array(ends - starts),
        ],
        schema=SCHEMA,
    )


def term_blocks(df: DataFrame, id_col: str, text_col: str, pattern: str = TERM, rows_per_map: int = 4096) -> DataFrame:
    """(term, block, bitmap, n): bitmaps and counters of each piece of a partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, texts, ids, chars = re.compile(pattern).findall, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not text:
                    continue
                texts.append(text)
                ids.append(i)
                chars += len(text)
                if len(ids) >= rows_per_map or chars > 1 << 24:
                    yield _vertical(texts, np.array(ids, np.int64), find)
                    texts, ids, chars = [], [], 0
        if ids:
            yield _vertical(texts, np.array(ids, np.int64), find)

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        build, "term string, block bigint, bitmap binary, n bigint"
    )


@F.pandas_udf(T.LongType())
def _merged_cardinality(blocks: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else cardinality(union(list(b))) for b in blocks], dtype="Int64")


def term_frequencies(df: DataFrame, id_col: str = "log_id", text_col: str = "text", **how) -> DataFrame:
    """(term, n_occurrences, n_rows) of every distinct term. Rows without an id are no records."""
    blocks = term_blocks(df, id_col, text_col, **how)
    merged = blocks.groupBy("term", "block").agg(F.collect_list("bitmap").alias("bitmaps"), F.sum("n").alias("n"))
    # A lone array needs no union: its cardinality is read from its length, in the JVM.
    lone = (F.size("bitmaps") == 1) & (F.octet_length(F.col("bitmaps")[0]) < 2 * DENSE)
    rows = F.coalesce(
        F.when(lone, (F.octet_length(F.col("bitmaps")[0]) / 2).cast("bigint")),
        _merged_cardinality(F.when(~lone, F.col("bitmaps"))),
    )
    return merged.select("term", "n", rows.alias("rows")).groupBy("term").agg(
        F.sum("n").alias("n_occurrences"), F.sum("rows").alias("n_rows")
    )


def marked_terms(df: DataFrame, min_rows: int = 3, max_share: float = 0.4, **how) -> DataFrame:
    """Term frequencies with ``mark``: 'rare' in fewer than ``min_rows`` rows, 'common' in more
    than ``max_share`` of all rows, else null."""
    total = df.agg(F.count("*").alias("_total"))
    return (
        term_frequencies(df, **how)
        .crossJoin(F.broadcast(total))  # one row
        .withColumn(
            "mark",
            F.when(F.col("n_rows") < min_rows, "rare").when(F.col("n_rows") > max_share * F.col("_total"), "common"),
        )
        .drop("_total")
    )
