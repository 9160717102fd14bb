"""Problem 9: mixing sources to target weights by Poisson replication.

Every document gets a uniform number from a hash of its id and the seed. Inverting the
Poisson distribution of its source's rate at that number, truncated at the source's cap,
gives the number of its copies. The rate is calibrated against the corpus itself: one
aggregation gives, per source, the tokens by bin of the uniform number, from which the tokens
any rate would select are read, so the rate is solved for what it really selects. Copies are
shuffled globally by a hash of id, copy and seed.

Sources are compared trimmed and in lower case. Documents of other or null sources, without
tokens or without an id are not used. A source too small for its share uses every document at
its cap; the shares reached are reported.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.tokens import VOCABULARY, token_counts
from gristmill.runtime import cut

#: Resolution of the uniform number when rates are calibrated.
BINS = 8192


def uniform(seed: int, *columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / float(1 << 53)


def poisson_steps(rate: float, cap: int) -> list[float]:
    """The points above which a uniform number gives at least 1, 2, ... cap copies."""
    if math.isinf(rate):
        return [-1.0] * cap
    term = total = math.exp(-rate)
    steps = []
    for k in range(1, cap + 1):
        steps.append(total)
        term *= rate / k
        total += term
    return steps


def solve_rate(above: np.ndarray, wanted: float, cap: int) -> float:
    """The rate at which the copies selected hold ``wanted`` tokens.

    ``above[i]``: tokens of the documents whose uniform number is at least i / BINS.
    """
    if wanted <= 0:
        return 0.0
    if wanted >= cap * above[0]:
        return math.inf

    def selected(rate: float) -> float:
        return sum(np.interp(s * BINS, np.arange(BINS + 1), above) for s in poisson_steps(rate, cap))

    low, high = 0.0, 1.0
    while selected(high) < wanted and high < 700:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if selected(middle) < wanted else (low, middle)
    return (low + high) / 2


#: Sources are few, which is checked; so what is collected or broadcast of them is bounded.
MOST_SOURCES = 10_000


def sized(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, tokenizer: str, seed: int) -> DataFrame:
    source = F.lower(F.trim(F.col("source")))
    named = df.where(F.col(id_col).isNotNull()).select(id_col, source.alias("source"), text_col)
    wanted = targets.select(F.lower(F.trim(F.col("source"))).alias("source")).dropDuplicates()
    if wanted.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError("too many sources")
    counted = token_counts(named.join(F.broadcast(wanted), "source", "left_semi"), [id_col, "source"], text_col, tokenizer)
    return cut(counted.where("n_tokens > 0")).withColumn("u", uniform(seed, id_col))


def plan_rates(docs: DataFrame, targets: DataFrame, total_tokens: int | None) -> list[tuple[str, float, int, list[float]]]:
    """(source, target share, cap, steps) per source; collects sources x BINS numbers."""
    rows = docs.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).collect()
    tokens: dict[str, np.ndarray] = {}
    for r in rows:
        tokens.setdefault(r.source, np.zeros(BINS + 1))[r.bin] = r.n
    total = total_tokens or sum(x.sum() for x in tokens.values())
    out = []
    for t in targets.select(F.lower(F.trim(F.col("source"))).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"]).collect():
        if t.source is None:
            continue
        cap = max(int(t.max_repeats or 0), 0)
        above = np.cumsum(tokens.get(t.source, np.zeros(BINS + 1))[::-1])[::-1]
        rate = solve_rate(above, float(t.target_share or 0) * total, cap) if cap else 0.0
        out.append((t.source, float(t.target_share or 0), cap, poisson_steps(rate, cap)))
    return out


def mix(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    total_tokens: int | None = None,
    seed: int = 17,
    tokenizer: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: id, source, copy_no, n_tokens, shuffle_key in global order of the key;
    report: source, target_share, max_repeats, n_docs, n_copies, n_tokens, actual_share.
    ``total_tokens`` defaults to the tokens of the named sources.
    """
    spark = df.sparkSession
    docs = sized(df, targets, id_col, text_col, tokenizer, seed)
    rates = plan_rates(docs, targets, total_tokens)
    schema = "source string, target_share double, max_repeats int, steps array<double>"
    plan = spark.createDataFrame(rates, schema)  # one row per source
    chosen = docs.join(F.broadcast(plan), "source").withColumn(
        "n_copies", F.size(F.filter("steps", lambda step: F.col("u") > step))
    )
    copies = (
        chosen.where("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .select(id_col, "source", "copy_no", "n_tokens", F.xxhash64(id_col, "copy_no", F.lit(seed + 1)).alias("shuffle_key"))
        .orderBy("shuffle_key", id_col, "copy_no")
    )
    per = chosen.groupBy("source").agg(
        F.count_if(F.col("n_copies") > 0).alias("n_docs"),
        F.sum("n_copies").alias("n_copies"),
        F.sum(F.col("n_copies") * F.col("n_tokens")).alias("n_tokens"),
    )
    report = plan.drop("steps").join(per, "source", "left").na.fill(0, ["n_docs", "n_copies", "n_tokens"])
    total = report.agg(F.sum("n_tokens").alias("_total"))
    report = report.crossJoin(F.broadcast(total)).withColumn(
        "actual_share", F.when(F.col("_total") > 0, F.col("n_tokens") / F.col("_total")).otherwise(0.0)
    )
    return copies, report.drop("_total")
