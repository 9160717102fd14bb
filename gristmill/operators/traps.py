"""Crawler traps as set operations: which URL patterns are banned, when, and what that disables.

``events``: host, pattern, seq, status, simhash, n_features; one row per response, ``simhash``
null where there is no page. A pattern is banned at the first of: too high an error rate, too
many pages, too many near-duplicates among earlier pages, too many pages of few words. Three
banned patterns below a path ban the subtree. Bans are monotone, so each is the minimum of
candidates, and all counters are prefix sums.

Exact repeats of a row count once. Rows with a null host, pattern or seq are left out. Order is
``seq`` alone, so late rows do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import conf

KEY = ["host", "pattern"]
REASONS = ("error_rate", "url_cap", "near_dup", "low_value")
#: Rows of one key whose sequence numbers share a block are summed in one task.
BLOCK = 1 << 16


def prefix_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Running sums per key in the order of an integer column, without one task per key.

    Each key's rows are cut into blocks of the order column; totals of earlier blocks are added
    to the running sums within a block, so a key that holds most rows is spread over its blocks.
    """
    named = df.select("*", F.floor(F.col(order) / block).alias("_block"), *[e.cast("bigint").alias(f"_x_{n}") for n, e in sums.items()])
    blocks = named.groupBy(*keys, "_block").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = named.select(*df.columns, "_block", *[F.sum(f"_x_{n}").over(within).alias(f"_r_{n}") for n in sums])
    joined = running.join(offsets, [*keys, "_block"])
    return joined.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def clean_events(events: DataFrame) -> DataFrame:
    known = events.select(*KEY, "seq", "status", "simhash", "n_features")
    return known.where("host is not null and pattern is not null and seq is not null").distinct()


def running_counts(events: DataFrame, limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """Events with requests, errors, page_no and low_no up to and with each row."""
    page = F.col("simhash").isNotNull()
    flag = lambda c: F.when(c, 1).otherwise(0)
    return prefix_sums(
        clean_events(events),
        KEY,
        "seq",
        {
            "requests": flag(F.col("status").between(100, 599)),
            "errors": flag(F.col("status").between(400, 499)),
            "page_no": flag(page),
            "low_no": flag(page & (F.coalesce("n_features", F.lit(0)) < limits.min_words)),
        },
    )


def first_near_dup_bans(pages: DataFrame, limits: conf.TrapThresholds) -> DataFrame:
    """(host, pattern, seq) of the first page with too many near-duplicates among earlier ones.

    ``pages`` holds at most ``max_urls`` pages a pattern, as later ones are banned anyway, so a
    group is bounded; within it the search stops at the first ban.
    """

    names = ["host", "pattern", "seq"]

    def first(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        h = group.column("simhash").to_numpy().view(np.uint64)
        for i in range(limits.min_pages + 1, len(h)):
            if int((np.bitwise_count(h[:i] ^ h[i]) <= limits.near_dup_distance).sum()) > limits.near_dup_trigger:
                return group.slice(i, 1).select(names)
        return group.slice(0, 0).select(names)

    enough = pages.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > limits.min_pages + 1).select(*KEY)
    return pages.join(enough, KEY, "left_semi").groupBy(*KEY).applyInArrow(first, "host string, pattern string, seq bigint")


def ban_candidates(events: DataFrame, limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """(host, pattern, seq, prio, reason); of near-duplicate bans only the first of a pattern."""
    counted = running_counts(events, limits)
    request = F.col("status").between(100, 599) & (F.col("requests") > limits.min_requests)
    page = F.col("simhash").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(request & (F.col("errors") * 100 > F.col("requests") * limits.error_percent), 0),
            F.when(page & (F.col("page_no") > limits.max_urls), 1),
            F.when(
                page & (F.coalesce("n_features", F.lit(0)) < limits.min_words) & (F.col("low_no") > limits.low_value_trigger), 3
            ),
        )
    )
    simple = counted.select(*KEY, "seq", F.explode(found).alias("prio"))
    firsts = simple.groupBy(*KEY).agg(F.min(F.struct("seq", "prio")).alias("b")).select(*KEY, "b.seq", "b.prio")
    pages = counted.where(page & (F.col("page_no") <= limits.max_urls)).select(*KEY, "seq", "simhash")
    near = first_near_dup_bans(pages, limits).withColumn("prio", F.lit(2))
    return firsts.unionByName(near)


def pattern_bans(events: DataFrame, limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """(host, pattern, seq, reason): the first ban of each banned pattern."""
    best = ban_candidates(events, limits).groupBy(*KEY).agg(F.min(F.struct("seq", "prio")).alias("b"))
    names = F.array(*[F.lit(r) for r in REASONS])
    return best.select(*KEY, "b.seq", F.get(names, F.col("b.prio")).alias("reason"))


def ancestors(pattern: Column, with_self: bool, min_depth: int) -> Column:
    """Paths above a pattern with at least ``min_depth`` slashes, from the top."""
    parts = F.split(pattern, "/", -1)
    n = F.size(parts) if with_self else F.size(parts) - 1
    paths = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    paths = F.when(n > 0, paths).otherwise(F.array().cast("array<string>"))
    return F.filter(paths, lambda p: F.length(p) - F.length(F.replace(p, F.lit("/"))) >= min_depth)


def subtree_bans(bans: DataFrame, limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """(host, subtree, seq): paths banned by their third banned descendant, and when."""
    above = bans.select("host", "seq", "pattern", F.explode(ancestors(F.col("pattern"), False, limits.subtree_min_depth)).alias("subtree"))
    order = Window.partitionBy("host", "subtree").orderBy("seq", "pattern")
    ranked = above.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limits.subtree_trigger)
    return ranked.where(F.col("_rank") == limits.subtree_trigger).select("host", "subtree", "seq")


def disabled_patterns(patterns: DataFrame, bans: DataFrame, subtrees: DataFrame) -> DataFrame:
    """``patterns`` (host, pattern, ...) that are banned or lie at or below a banned subtree.

    The paths above each pattern meet the bans by equality, so no prefix is compared with all.
    """
    keys = patterns.select(*KEY).distinct()
    own = keys.join(bans.select(*KEY), KEY, "left_semi")
    paths = keys.select(*KEY, F.explode(ancestors(F.col("pattern"), True, 0)).alias("subtree"))
    below = paths.join(subtrees.select("host", "subtree"), ["host", "subtree"], "left_semi").select(*KEY)
    return patterns.join(own.union(below).distinct(), KEY, "left_semi")


def enabled_patterns(patterns: DataFrame, bans: DataFrame, subtrees: DataFrame) -> DataFrame:
    """``patterns`` that are neither banned nor at or below a banned subtree; unknown ones are enabled."""
    return patterns.join(disabled_patterns(patterns.select(*KEY).distinct(), bans, subtrees), KEY, "left_anti")


def error_rates(events: DataFrame) -> DataFrame:
    """(host, pattern, seq, requests, errors) of each request."""
    counted = running_counts(events)
    return counted.where(F.col("status").between(100, 599)).select(*KEY, "seq", "requests", "errors")


