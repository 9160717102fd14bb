"""A crawl by rounds over recorded responses: each round fetches all that is due at once.

Rounds visit breadth first, so once bans fire, the pages seen may differ from a crawl that
fetches one page at a time; on a recorded ``seq`` the trap operators are exact.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.functions import urls
from gristmill.operators import frontier, responses, traps
from gristmill.runtime import cut


def crawl(recorded: DataFrame, seeds: DataFrame, rounds: int | None = None, scope: conf.Scope = conf.Scope(), limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """(round, url, outcome) of every URL fetched. Seeds are taken as they are; links must be
    admitted. ``recorded``: url, status, raw and, where there are several responses of a URL, resp_id,
    of which the least is used (without it, any). A URL
    without a response has the outcome 'missing'. Runs until no URL is due, or for ``rounds`` rounds.
    """
    answers = recorded.where("url is not null")
    if "resp_id" in recorded.columns:
        first = answers.groupBy("url").agg(F.min("resp_id").alias("resp_id"))
        answers = answers.join(first, ["url", "resp_id"], "left_semi")
    answers = answers.dropDuplicates(["url"])
    due = seeds.where("url is not null").select("url").distinct()
    known = due.select(urls.url_hash(F.col("url")).alias("url_hash")).distinct()
    seen = due.sparkSession.createDataFrame([], "host string, dedup_key string")
    events = due.sparkSession.createDataFrame([], "host string, pattern string, seq bigint, status int, simhash bigint, n_features int")
    done = None
    for i in count(1) if rounds is None else range(1, rounds + 1):
        fetched = cut(responses.with_outcome(due.join(answers.select("url", "status", "raw"), "url", "left")).select(
            "url", "status", "raw", F.when(F.col("status").isNull() & F.col("raw").isNull(), "missing").otherwise(F.col("outcome")).alias("outcome"),
            F.xxhash64("url").bitwiseAND(F.lit((1 << 40) - 1)).alias("at"),
        ))
        row = fetched.select(F.lit(i).alias("round"), "url", "outcome")
        done = row if done is None else done.union(row)
        if i == rounds:
            break
        fresh = responses.page_events(fetched.where("outcome <> 'missing'").withColumn("seq0", F.lit(i).cast("bigint") * (1 << 40) + F.col("at")), "seq0")
        events = cut(events.union(fresh.select(*events.columns)))
        bans = cut(traps.pattern_bans(events, limits))
        subtrees = cut(traps.subtree_bans(bans, limits))
        found = responses.links(responses.parsed_pages(fetched, "url"), "url").select("link").union(responses.redirects(fetched, "url").select("target"))
        found = found.where("link is not null").groupBy(F.col("link").alias("url")).agg(F.min(F.xxhash64("link")).alias("seq"))
        checked = frontier.verdicts(found, bans, subtrees, scope, seen)
        accepted = checked.where("verdict = 'accept'").select("url", urls.url_hash(F.col("url")).alias("url_hash"), "host", "dedup_key")
        new = cut(accepted.join(known, "url_hash", "left_anti"))
        seen = cut(seen.union(checked.where("verdict <> 'out-of-scope'").select("host", "dedup_key")).distinct())
        known = cut(known.union(new.select("url_hash")).distinct())
        due = new.select("url").distinct()
        if rounds is None and due.isEmpty():
            break
    return done
