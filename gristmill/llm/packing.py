"""Problem 8: filling fixed-capacity containers with texts of varying length.

Shortest-pack-first over the length histogram: lengths are placed longest first, each into
the open packs with the most room that can take it; equal packs are one pattern with a count.
The histogram has at most one entry per length up to the capacity, so the planning on the
driver is bounded by the capacities, whatever the number of documents. Patterns are joined
back by the rank of a piece among the pieces of its length.

Only a text larger than a container is split: into full pieces and a remainder. A text
without tokens (null, empty) takes no room and is not listed. Repeated ids are packed apart.
"""

from __future__ import annotations

import heapq
from itertools import count as counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.tokens import VOCABULARY, token_counts
from gristmill.runtime import cut

#: Ranks are counted within (capacity, length, salt). A length has as many salts as keep its windows at
#: about so many pieces, so a hot length (such as that of all full pieces) is spread however many they are.
WINDOW = 50_000
#: Capacities are few, which is checked; so their pieces, plans and histogram are bounded.
MOST_CAPACITIES = 1_000


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how often}, number of containers) that hold all lengths of the histogram."""
    tie = counter()
    heap: list[tuple[int, int, dict[int, int], int]] = []  # (-free space, tie, pattern, containers)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                free, _, pattern, n = heapq.heappop(heap)
                free, take = -free, min(n, left)
                if n > take:
                    heapq.heappush(heap, (-free, next(tie), pattern, n - take))
                grown = dict(pattern)
                grown[length] = grown.get(length, 0) + 1
                heapq.heappush(heap, (length - free, next(tie), grown, take))
                left -= take
            else:
                # No open pack has room: new ones, as few as can hold the rest.
                per = min(left, capacity // length)
                n = left // per
                heapq.heappush(heap, (per * length - capacity, next(tie), {length: per}, n))
                left -= n * per
    return [(pattern, n) for _, _, pattern, n in heap]


def rank_intervals(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each interval, its first container, and items per container."""
    starts: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, n in patterns:
        for length, times in pattern.items():
            first = used.get(length, 0)
            starts.setdefault(length, []).append((first, base, times))
            used[length] = first + times * n
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in starts.items()}


def pieces_of(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row per piece: a text that fits is one piece, a larger one full pieces and a rest."""
    n, c = F.col("n_tokens"), F.col("capacity")
    return (
        sizes.where(n > 0)
        .crossJoin(F.broadcast(capacities))  # at most MOST_CAPACITIES
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), (F.ceil(n / c) - 1).cast("int"))))
        .withColumn("length", F.least(c, n - F.col("piece_no") * c).cast("int"))
    )


def pack(
    df: DataFrame,
    capacities: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = VOCABULARY,
    window: int = WINDOW,
) -> DataFrame:
    """(pack_name, container_id, id, piece_no, n_tokens) of every piece of every text.

    ``capacities``: pack_name, capacity_tokens; null names and null or non-positive capacities are ignored.
    """
    caps = capacities.select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    caps = caps.where("capacity > 0 and pack_name is not null").dropDuplicates()
    if caps.limit(MOST_CAPACITIES + 1).count() > MOST_CAPACITIES:
        raise ValueError("too many capacities")
    sizes = cut(token_counts(df, [id_col], text_col, tokenizer))
    group = ["pack_name", "capacity", "length"]
    plain = pieces_of(sizes, caps)
    totals = cut(plain.groupBy(*group).agg(F.count("*").alias("n")))
    salts = totals.select(*group, F.ceil(F.col("n") / window).cast("bigint").alias("salts"))
    pieces = plain.join(salts, group).withColumn("salt", F.pmod(F.xxhash64(id_col, "piece_no"), F.col("salts"))).drop("salts")
    per_salt = cut(pieces.groupBy(*group, "salt").agg(F.count("*").alias("n")))
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for row in totals.collect():  # at most the sum of the capacities
        histogram.setdefault((row.pack_name, row.capacity), {})[row.length] = row.n
    plans = {k: rank_intervals(pack_histogram(v, k[1])) for k, v in histogram.items()}

    @F.pandas_udf("bigint")
    def container(name: pd.Series, capacity: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), np.int64)
        keys = pd.DataFrame({"n": name, "c": capacity, "l": length})
        for (n, c, size), rows in keys.groupby(["n", "c", "l"], sort=False, dropna=False).indices.items():
            first, base, times = plans[(n, c)][size]
            r = rank.to_numpy()[rows]
            i = np.searchsorted(first, r, "right") - 1
            out[rows] = base[i] + (r - first[i]) // times[i]
        return pd.Series(out)

    before = F.sum("n").over(Window.partitionBy(*group).orderBy("salt")) - F.col("n")
    offsets = per_salt.withColumn("before", before).drop("n")
    within = F.row_number().over(Window.partitionBy(*group, "salt").orderBy(id_col, "piece_no")) - 1
    ranked = pieces.withColumn("within", within).join(offsets, [*group, "salt"])
    return ranked.select(
        "pack_name",
        container("pack_name", "capacity", "length", F.col("before") + F.col("within")).alias("container_id"),
        id_col,
        "piece_no",
        F.col("length").cast("bigint").alias("n_tokens"),
    )


def pack_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, and the share of room that is filled."""
    per = packed.groupBy("pack_name").agg(
        F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    caps = capacities.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").dropDuplicates()
    return per.join(F.broadcast(caps), "pack_name").withColumn(
        "fill_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    )
