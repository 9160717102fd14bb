"""The crawl frontier as a table (url_hash, url, completed, seq): enqueue, dequeue, complete, load.

Later rows of a hash add to earlier ones: the first URL stays, and the entry is complete once
any row says so. A null flag says nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.functions import rules, urls
from gristmill.operators import traps
from gristmill.runtime import cut


def state(frontier: DataFrame) -> DataFrame:
    """One row per hash: url_hash, url and seq of the first row, completed."""
    merged = frontier.where("url is not null and seq is not null").groupBy(urls.url_hash(F.col("url")).alias("url_hash")).agg(
        F.min(F.struct("seq", "url")).alias("f"), F.max(F.coalesce("completed", F.lit(False))).alias("completed")
    )
    return merged.select("url_hash", "f.url", "completed", "f.seq")


def enqueue(current: DataFrame, found: DataFrame) -> DataFrame:
    """New entries of ``found`` (url, seq), whose hash is not in ``current``; the first of equals."""
    return state(found.select("url", F.lit(False).alias("completed"), "seq")).join(current.select("url_hash"), "url_hash", "left_anti")


def with_pattern(entries: DataFrame) -> DataFrame:
    n = entries.withColumn("_n", urls.normalized(F.col("url")))
    return n.select(*entries.columns, F.col("_n.netloc").alias("host"), F.get(F.col("_n.bucket_keys"), F.lit(0)).alias("pattern"))


def allowed(todo: DataFrame, bans: DataFrame, subtrees: DataFrame) -> DataFrame:
    """Entries with host and pattern that are not banned; those without a host never are."""
    named = with_pattern(todo)
    return named.where("host is null").union(traps.enabled_patterns(named.where("host is not null"), bans, subtrees).select(*named.columns))


def dequeue(current: DataFrame, bans: DataFrame, subtrees: DataFrame, n: int) -> DataFrame:
    """The next ``n`` entries to fetch, last in first out, with their rank; entries whose pattern
    was banned meanwhile are passed over, those without a host never are."""
    top = allowed(current.where("not completed"), bans, subtrees).orderBy(F.desc("seq")).limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("seq"))).alias("rank"), "url_hash", "url", "seq")


def complete(current: DataFrame, done: DataFrame) -> DataFrame:
    """``current`` with the URLs of ``done`` marked; unknown ones are added as complete."""
    marks = done.select("url", F.lit(True).alias("completed"), F.lit((1 << 62)).cast("bigint").alias("seq"))
    return state(current.select("url", "completed", "seq").union(marks))


def verdicts(
    found: DataFrame,
    bans: DataFrame,
    subtrees: DataFrame,
    scope: conf.Scope = conf.Scope(),
    seen: DataFrame | None = None,
) -> DataFrame:
    """``found`` (url, seq) with host, dedup_key, pattern and verdict of admission.

    In order: out-of-scope, seen, banned-bucket, bad-scheme, bad-extension, accept. A URL in
    scope marks its key as seen even if a later check rejects it; ``seen`` holds host and
    dedup_key of earlier ones. A null or invalid URL is out of scope.
    """
    n = found.select("url", "seq", urls.normalized(F.col("url")).alias("n"))
    rows = n.select(
        "url", "seq", F.col("n.netloc").alias("host"), F.col("n.dedup_key").alias("dedup_key"), F.get(F.col("n.bucket_keys"), F.lit(0)).alias("pattern"), F.col("n.scheme").alias("_scheme")
    ).withColumn("_in", rules.host_in_scope(F.col("host"), scope))
    # Three branches read these rows: they are made once, as URLs are dear to take apart.
    rows = cut(rows)
    inside = rows.where("_in")
    firsts = inside.groupBy("host", "dedup_key").agg(F.min("seq").alias("_first"))
    if seen is not None:
        firsts = firsts.join(seen.select("host", "dedup_key"), ["host", "dedup_key"], "left_anti")
    off = traps.disabled_patterns(inside.select("host", "pattern").distinct(), bans, subtrees).withColumn("_off", F.lit(True))
    joined = rows.join(firsts, ["host", "dedup_key"], "left").join(off, ["host", "pattern"], "left")
    verdict = (
        F.when(~F.col("_in"), "out-of-scope")
        .when(F.col("_first").isNull() | (F.col("_first") != F.col("seq")), "seen")
        .when(F.col("_off"), "banned-bucket")
        .when(~rules.scheme_ok(F.col("_scheme")), "bad-scheme")
        .when(~rules.extension_ok(urls.path_without_params(F.col("url"))), "bad-extension")
        .otherwise("accept")
    )
    return joined.select("seq", "url", "host", "dedup_key", "pattern", verdict.alias("verdict"))


def load(saved: DataFrame, bans: DataFrame, subtrees: DataFrame, scope: conf.Scope = conf.Scope()) -> DataFrame:
    """Saved entries to fetch again: not complete and admitted, the first per page."""
    todo = state(saved).where("not completed")
    kept = verdicts(todo.select("url", "seq"), bans, subtrees, scope).where("verdict = 'accept'")
    return todo.join(kept.select("seq"), "seq", "left_semi").select("url_hash", "url", "seq")
