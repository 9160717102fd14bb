"""Traps on a stream: a stateful operator per host and pattern that emits a ban when it falls.

A ban depends on the pattern's own events only, so a large host is spread over its patterns. The
state holds a pattern's counters and page hashes, at most ``max_urls``, as bytes, and nothing but
a mark once it is banned. Events of a micro-batch are taken in the order of ``seq``; repeats of a
(pattern, seq) already seen in the batch are dropped. Events arriving in a later batch than
their successors are taken as they come, as a crawl would.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill import conf
from gristmill.runtime import scratch

OUT = "host string, pattern string, seq bigint, reason string"
EVENT = "host string, pattern string, seq bigint, status int, simhash bigint, n_features int"


class PatternState:
    """Counters of one pattern until its ban."""

    __slots__ = ("banned", "errors", "hashes", "low", "requests", "size")

    def __init__(self) -> None:
        self.banned, self.errors, self.requests, self.low, self.size = False, 0, 0, 0, 0
        self.hashes = np.zeros(32, np.uint64)

    def __getstate__(self) -> tuple:
        return self.banned, self.errors, self.requests, self.low, self.size, self.hashes[: self.size].tobytes()

    def __setstate__(self, state: tuple) -> None:
        self.banned, self.errors, self.requests, self.low, self.size, raw = state
        self.hashes = np.frombuffer(raw, np.uint64).copy()

    def take(self, status: int | None, simhash: int | None, n_features: int, limits: conf.TrapThresholds) -> str | None:
        """Count one response; the reason if it bans the pattern."""
        if self.banned:
            return None
        reason = None
        if status is not None and 100 <= status <= 599:
            self.requests += 1
            self.errors += 400 <= status <= 499
            if self.requests > limits.min_requests and self.errors * 100 > self.requests * limits.error_percent:
                reason = "error_rate"
        if reason is None and simhash is not None:
            h = np.uint64(simhash & (1 << 64) - 1)
            if self.size + 1 > limits.max_urls:
                reason = "url_cap"
            elif self.size > limits.min_pages:
                near = np.bitwise_count(self.hashes[: self.size] ^ h) <= limits.near_dup_distance
                reason = "near_dup" if int(near.sum()) > limits.near_dup_trigger else None
            if reason is None:
                if self.size == len(self.hashes):
                    self.hashes = np.resize(self.hashes, max(32, 2 * self.size))
                self.hashes[self.size] = h
                self.size += 1
                if n_features < limits.min_words:
                    self.low += 1
                    reason = "low_value" if self.low > limits.low_value_trigger else None
        if reason:
            self.banned, self.hashes, self.size = True, np.zeros(0, np.uint64), 0
        return reason


def ban_stream(events: DataFrame, limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """Stream of bans (host, pattern, seq, reason) of a stream of events; null keys are left out."""
    names = ["host", "pattern", "seq", "reason"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own: PatternState = pickle.loads(state.get[0]) if state.exists else PatternState()
        if own.banned:
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").drop_duplicates("seq")
        for r in rows.itertuples(index=False):
            status = None if pd.isna(r.status) else int(r.status)
            simhash = None if r.simhash_text is None or pd.isna(r.simhash_text) else int(r.simhash_text)
            reason = own.take(status, simhash, 0 if pd.isna(r.n_features) else int(r.n_features), limits)
            if reason:
                yield pd.DataFrame([(*key, int(r.seq), reason)], columns=names)
                break
        state.update((pickle.dumps(own),))

    known = events.where("host is not null and pattern is not null and seq is not null")
    # Hashes travel as text: a nullable 64-bit integer would pass through a float in pandas.
    known = known.select("host", "pattern", "seq", "status", F.col("simhash").cast("string").alias("simhash_text"), "n_features")
    return known.groupBy("host", "pattern").applyInPandasWithState(step, OUT, "counters binary", "append", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, path: str, limits: conf.TrapThresholds = conf.TrapThresholds()) -> DataFrame:
    """Bans of all events stored at ``path``, found by the stream in one available-now run."""
    run = scratch(spark, "stream")
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.parquet(path).inputFiles()
    # A stream reads folders: a lone file is picked out of its own.
    alone = len(files) == 1 and files[0].endswith(f"/{name}")
    source = spark.readStream.schema(EVENT)
    events = source.option("pathGlobFilter", name).parquet(folder) if alone else source.parquet(path)
    query = (
        ban_stream(events, limits)
        .writeStream.format("parquet")
        .option("path", f"{run}/bans")
        .option("checkpointLocation", f"{run}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(OUT).parquet(f"{run}/bans")
