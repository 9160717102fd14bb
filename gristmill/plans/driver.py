"""A crawl against a cache server that survives restarts: everything it knows lies in one folder.

``frontier`` (URLs and their completion), ``log`` (pages as JSON lines by host), ``events`` (what each
response registers with the traps), ``seen`` (page keys met) and ``rejects`` (links not taken, with the
reason) are only appended to. Each round fetches all that is due and not banned meanwhile; a URL is
complete once its links are added, so a round that is lost is fetched again, and nothing is lost.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.operators import frontier, responses, traps
from gristmill.runtime import cut
from gristmill.sources import frontier_store, http, pagelog

EVENTS = "host string, pattern string, seq bigint, status int, simhash bigint, n_features int"
SEEN = "host string, dedup_key string"
#: Sequence numbers: the round, and within it a hash of the URL.
ROUND = 1 << 40


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not frontier_store.exists(spark, path):
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def run(
    spark: SparkSession,
    config: conf.CrawlConfig,
    folder: str,
    restart: bool = False,
    rounds: int | None = None,
    scope: conf.Scope = conf.Scope(),
    limits: conf.TrapThresholds = conf.TrapThresholds(),
) -> DataFrame:
    """Crawl from the seeds of ``config``, or on from where the folder stands, until nothing is due or for
    ``rounds`` rounds; the frontier's state. ``restart`` drops what the folder holds."""
    store, events, seen, rejects = (f"{folder}/{x}" for x in ("frontier", "events", "seen", "rejects"))
    if restart:
        for path in (store, events, seen, rejects, f"{folder}/log"):
            frontier_store.drop(spark, path)
    state = frontier_store.open_store(spark, store, config.seed_urls)
    last = _read(spark, events, EVENTS).agg(F.max("seq")).first()[0]
    first = 1 + (0 if last is None else last // ROUND)
    for i in count(first) if rounds is None else range(first, first + rounds):
        bans = cut(traps.pattern_bans(_read(spark, events, EVENTS), limits))
        subtrees = cut(traps.subtree_bans(bans, limits))
        due = frontier.allowed(state.where("not completed"), bans, subtrees).select("url")
        due = cut(due.repartition(config.threads))
        if due.isEmpty():
            break
        number = F.lit(i).cast("bigint") * ROUND + F.xxhash64("url").bitwiseAND(F.lit(ROUND - 1))
        # Fetched once: all that follows reads this table.
        fetched = cut(responses.with_outcome(http.responses(due, config)).withColumn("seq", number))
        found_events = cut(responses.page_events(fetched, "seq"))
        pages = cut(responses.parsed_pages(fetched, "url", "seq"))
        logged = pages.join(found_events.where("simhash is not null").select("seq", "simhash").distinct(), "seq")
        pagelog.write(logged.select("url", "text", "simhash", F.unix_timestamp().cast("double").alias("fetched_at")), f"{folder}/log")
        links = responses.links(pages, "url").select("link").union(responses.redirects(fetched, "url").select(F.col("target").alias("link")))
        links = links.where("link is not null").groupBy(F.col("link").alias("url")).agg(F.lit(i).cast("bigint") * ROUND + F.min(F.xxhash64("link").bitwiseAND(F.lit(ROUND - 1))))
        checked = cut(frontier.verdicts(links.toDF("url", "seq"), bans, subtrees, scope, _read(spark, seen, SEEN)))
        checked.where("verdict <> 'accept'").select("seq", "url", "verdict").write.mode("append").parquet(rejects)
        new = frontier.enqueue(state, checked.where("verdict = 'accept'").select("url", "seq"))
        frontier_store.append(new, store)
        checked.where("verdict <> 'out-of-scope'").select("host", "dedup_key").distinct().write.mode("append").parquet(seen)
        found_events.select(*[x.split()[0] for x in EVENTS.split(", ")]).write.mode("append").parquet(events)
        frontier_store.mark_complete(fetched.select("url"), store)
        state = frontier_store.open_store(spark, store)
    return state
