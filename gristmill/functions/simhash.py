"""64-bit SimHash as used for pages, and its distance, as column expressions and in numpy.

Features are the runs of letters, digits and ``_`` in the lower-cased text, repeats counted.
Each feature's hash is the first 8 bytes of its MD5 digest, read little-endian. A bit of the
SimHash is set where more features set it than not (ties give 0); no features give 0. Values
are signed 64-bit integers (two's complement).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE = r"[\p{L}\p{N}_]+"
_FEATURE = re.compile(r"\w+")
_BITS = np.arange(64, dtype=np.uint64)


@lru_cache(maxsize=1 << 17)
def feature_hash(feature: str) -> int:
    digest = hashlib.md5(feature.encode("utf-8", "replace"), usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "little")


def simhash_of(features: list[str]) -> int:
    """Signed SimHash of a list of features."""
    if not features:
        return 0
    counts = Counter(features)
    hashes = np.fromiter(map(feature_hash, counts), np.uint64, len(counts))
    weights = np.fromiter(counts.values(), np.int64, len(counts))
    score = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = (hashes[i : i + 8192, None] >> _BITS) & np.uint64(1)
        score += weights[i : i + 8192] @ (2 * bits.astype(np.int64) - 1)
    value = int(((score > 0).astype(np.uint64) << _BITS).sum(dtype=np.uint64))
    return value - (1 << 64) if value >> 63 else value


def features_of(text: str | None) -> list[str]:
    return _FEATURE.findall(text.lower()) if text else []


@F.pandas_udf(T.LongType())
def text_simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash of each text; null texts count as empty."""
    for texts in batches:
        yield pd.Series([simhash_of(features_of(t)) for t in texts], dtype="int64")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks(value: Column, distance_bits: int = 3) -> Column:
    """Array of (block number, block bits): of distance + 1 blocks of two values that differ in
    at most ``distance_bits`` bits, at least one is equal."""
    n = distance_bits + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(value, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("bits"),
            )
            for i in range(n)
        ]
    )


def from_unsigned(value: Column) -> Column:
    """Unsigned decimal(20,0) to the signed 64-bit value of the same bits."""
    text = value.cast("decimal(20,0)")
    wrapped = text - F.lit(Decimal(1 << 64))
    return F.when(text >= F.lit(Decimal(1 << 63)), wrapped.cast("bigint")).otherwise(text.cast("bigint"))


def to_unsigned(value: Column) -> Column:
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, (wide + F.lit(Decimal(1 << 64))).cast("decimal(20,0)")).otherwise(wide)


def _bits(value: Column, low: int, high: int) -> Column:
    shifted = F.shiftrightunsigned(value, low) if low else value
    return shifted if high - low == 64 else shifted.bitwiseAND(F.lit((1 << (high - low)) - 1))


def table_keys(value: Column, k: int = 3) -> Column:
    """Array of (block, bits, part, rest): keys under which two values within distance k meet.

    Of k + 1 blocks at least one agrees; of k + 1 parts of the other bits again at least one
    does. Both together key (k + 1)**2 tables of far more bits than one block has.
    """
    n, keys = k + 1, []
    for b in range(n):
        low, high = round(64 * b / n), round(64 * (b + 1) / n)
        above = F.shiftleft(F.shiftrightunsigned(value, high), low) if high < 64 else F.lit(0).cast("bigint")
        other = above.bitwiseOR(_bits(value, 0, low)) if low else above
        room = 64 - (high - low)
        for p in range(n):
            keys.append(
                F.struct(
                    F.lit(b).alias("block"),
                    _bits(value, low, high).alias("bits"),
                    F.lit(p).alias("part"),
                    _bits(other, round(room * p / n), round(room * (p + 1) / n)).alias("rest"),
                )
            )
    return F.array(*keys)
