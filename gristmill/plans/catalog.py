"""The queries of the core operators and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.functions import rules, simhash, text, urls
from gristmill.operators import frontier, near, responses, stats, traps
from gristmill.plans import crawl, sql
from gristmill.runtime import cut, scratch, table
from gristmill.sources import pagelog
from gristmill.streaming import traps as stream

Query = Callable[[SparkSession, str], DataFrame]
#: The tables' scope: computing hosts of one university, others are out.
SCOPE = conf.Scope(domain="mereford.example")
#: Thresholds so low that each kind of ban, and bans of subtrees, fall in tables of any size.
LOW = conf.TrapThresholds(min_pages=3, max_urls=40, near_dup_trigger=2, low_value_trigger=3, min_requests=4, error_percent=30, subtree_trigger=2)
#: Lower still, as a page log has few pages of one pattern.
LEAST = replace(LOW, max_urls=2, min_pages=1, near_dup_trigger=0, min_words=200, low_value_trigger=1)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pagelog").withColumnRenamed("log_id", "seq")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trap_events")


def url_normalize(spark, sf_dir):
    n = table(spark, sf_dir, "pagelog").select("log_id", urls.normalized(F.col("fetch_url")).alias("n"))
    return n.select(
        "log_id", F.col("n.fetch_url").alias("clean_url"), F.col("n.dedup_key").alias("page_key"), F.get(F.col("n.bucket_keys"), F.lit(0)).alias("bucket_key"), "n.scheme", "n.netloc", "n.path", "n.query"
    )


def url_pattern(spark, sf_dir):
    path = urls.part(F.col("url"), 3)
    return table(spark, sf_dir, "frontier").where("url is not null").select("seq", path.alias("path"), urls.path_pattern(path).alias("pattern"))


def url_hash(spark, sf_dir):
    return table(spark, sf_dir, "frontier").where("url is not null").select("seq", urls.url_hash(F.col("url")).alias("hash"))


def scope_filter(spark, sf_dir):
    host = urls.without_www(urls.host(F.col("url")))
    return table(spark, sf_dir, "frontier").where(rules.host_in_scope(host, SCOPE)).select("seq", host.alias("host"))


def _bans(spark, sf_dir):
    # Bans are asked for several times in a plan: they are few rows, and made once.
    bans = cut(traps.pattern_bans(_events(spark, sf_dir), LOW))
    return bans, cut(traps.subtree_bans(bans, LOW))


def admission_verdict(spark, sf_dir):
    bans, subtrees = _bans(spark, sf_dir)
    found = table(spark, sf_dir, "frontier").select("url", "seq")
    return frontier.verdicts(found, bans, subtrees, SCOPE).select("seq", "host", "dedup_key", "pattern", "verdict")


def _first(spark, sf_dir):
    return stats.first_pages(_log(spark, sf_dir).select("seq", "fetch_url", "text"))


def first_wins_dedup(spark, sf_dir):
    return stats.first_pages(_log(spark, sf_dir).select("seq", "fetch_url")).select("seq", "page_key", "host", "url")


def unique_pages(spark, sf_dir):
    return first_wins_dedup(spark, sf_dir).agg(F.count("*").alias("n_pages"))


def subdomain_counts(spark, sf_dir):
    return stats.pages_by_host(first_wins_dedup(spark, sf_dir))


def longest_page(spark, sf_dir):
    return stats.longest_page(_first(spark, sf_dir))


def largest_pages_top10(spark, sf_dir):
    return stats.largest_pages(_first(spark, sf_dir))


def word_counts_top50(spark, sf_dir):
    return stats.top_words(stats.word_frequencies(_first(spark, sf_dir), table(spark, sf_dir, "stop_words")))


def word_frequencies(spark, sf_dir):
    return stats.word_frequencies(_first(spark, sf_dir), table(spark, sf_dir, "stop_words")).select("word", "n")


def response_filter(spark, sf_dir):
    return responses.with_outcome(table(spark, sf_dir, "responses")).select("resp_id", "outcome")


def response_redirects(spark, sf_dir):
    return responses.redirects(responses.with_outcome(table(spark, sf_dir, "responses")), "resp_id")


def _pages(spark, sf_dir):
    return responses.parsed_pages(responses.with_outcome(table(spark, sf_dir, "responses")), "resp_id")


def html_links(spark, sf_dir):
    return responses.links(_pages(spark, sf_dir), "resp_id")


def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("resp_id", "text")


def response_events(spark, sf_dir):
    return responses.page_events(table(spark, sf_dir, "responses"), "resp_id")


def doc_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.features(F.col("text"))).alias("n_features"), F.size(text.words(F.col("text"))).alias("n_words"))


def doc_simhash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", simhash.text_simhash("text").alias("simhash"))


def near_dup_values(spark, sf_dir):
    """Class representatives within distance 3; doc_simhash gives the membership."""
    return near.near_values(doc_simhash(spark, sf_dir))


def near_dup_search(spark, sf_dir):
    """Of every document whose id is divisible by 20: the SimHash values of all documents within
    distance 3, and how many documents have each."""
    prints = cut(doc_simhash(spark, sf_dir))
    return near.search(prints.where("doc_id % 20 = 0"), prints).select("doc_id", "value", "distance", "n_entries")


def near_dup_log_values(spark, sf_dir):
    logged = table(spark, sf_dir, "pagelog").select(simhash.from_unsigned(F.col("simhash")).alias("simhash"))
    return near.near_values(logged)


def low_value_docs(spark, sf_dir):
    return doc_features(spark, sf_dir).where(F.col("n_features") < conf.TrapThresholds().min_words).select("doc_id", "n_features")


def running_error_rate(spark, sf_dir):
    return traps.error_rates(_events(spark, sf_dir))


def pattern_bans(spark, sf_dir):
    return traps.pattern_bans(_events(spark, sf_dir))


def subtree_bans(spark, sf_dir):
    return _bans(spark, sf_dir)[1]


def enabled_after_bans(spark, sf_dir):
    patterns = traps.clean_events(_events(spark, sf_dir)).select("host", "pattern").distinct()
    return traps.enabled_patterns(patterns, *_bans(spark, sf_dir))


def streamed_bans(spark, sf_dir):
    """Bans found by the stateful streaming operator over the same events."""
    return stream.run_to_end(spark, f"{sf_dir}/trap_events.parquet")


def replay_bans(spark, sf_dir):
    """Bans that a restart restores from the page log."""
    return traps.pattern_bans(pagelog.replay(_log(spark, sf_dir)), LEAST)


def low_bans(spark, sf_dir):
    """Bans by low thresholds: all four reasons."""
    return traps.pattern_bans(_events(spark, sf_dir), LOW)


def log_order(spark, sf_dir):
    """The page log written as JSON lines by host and read back in order of files and lines."""
    rows = table(spark, sf_dir, "pagelog").select("log_id", urls.normalized(F.col("fetch_url"))["netloc"].alias("host")).where("host is not null")
    folder = scratch(spark, "log")
    lines = rows.select("host", F.concat(F.lit("http://"), "host", F.lit("/")).alias("fetch_url"), F.col("log_id").cast("double").alias("fetched_at"))
    lines.repartition("host").sortWithinPartitions("host", "fetched_at").write.partitionBy("host").json(folder)
    return pagelog.read(spark, folder).select("seq", F.col("fetched_at").cast("bigint").alias("log_id"), F.split("fetch_url", "/")[2].alias("host"))


def replay_events(spark, sf_dir):
    return pagelog.replay(_log(spark, sf_dir)).select("host", "pattern", "seq", "simhash", "n_features", "dedup_key")


def frontier_state(spark, sf_dir):
    return frontier.state(table(spark, sf_dir, "frontier"))


def frontier_load(spark, sf_dir):
    return frontier.load(table(spark, sf_dir, "frontier"), *_bans(spark, sf_dir), SCOPE)


def frontier_dequeue(spark, sf_dir):
    """The next 100 entries to fetch (a top-k by its nature)."""
    return frontier.dequeue(frontier_state(spark, sf_dir), *_bans(spark, sf_dir), 100)


def frontier_enqueue(spark, sf_dir):
    """Links of the pages that the frontier doesn't know yet."""
    found = html_links(spark, sf_dir).select(F.col("link").alias("url"), (F.col("resp_id") * 100_000 + F.col("pos")).alias("seq"))
    return frontier.enqueue(frontier_state(spark, sf_dir), found).select("url_hash", "url", "seq")


def crawl_rounds(spark, sf_dir):
    """A crawl over recorded responses until nothing is due, from the frontier's open URLs and all
    recorded URLs in scope, as those are what can be answered."""
    recorded = table(spark, sf_dir, "responses")
    host = urls.normalized(F.col("url"))["netloc"]
    answered = recorded.where(rules.host_in_scope(host, SCOPE)).select("url")
    seeds = frontier_state(spark, sf_dir).where("not completed").select("url").union(answered)
    return crawl.crawl(recorded, seeds, scope=SCOPE)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        subdomain_counts, url_normalize, url_pattern, url_hash, scope_filter, admission_verdict, first_wins_dedup, unique_pages,
        longest_page, largest_pages_top10, word_counts_top50, word_frequencies, response_filter, response_redirects, html_links, html_text,
        response_events, doc_features, doc_simhash, near_dup_values, near_dup_search, near_dup_log_values, low_value_docs, running_error_rate, pattern_bans,
        low_bans, subtree_bans, enabled_after_bans, streamed_bans, replay_bans, replay_events, log_order, frontier_state, frontier_load, frontier_dequeue,
        frontier_enqueue, crawl_rounds,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
