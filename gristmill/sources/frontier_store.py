"""The frontier on disk: a Parquet table that is opened, seeded, appended to and compacted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import urls
from gristmill.operators import frontier

SCHEMA = "url_hash string, url string, completed boolean, seq bigint"


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return system.exists(target)


def drop(spark: SparkSession, path: str) -> None:
    system, target = _place(spark, path)
    system.delete(target, True)


def append(rows: DataFrame, path: str) -> None:
    rows.select("url_hash", "url", "completed", "seq").write.mode("append").parquet(path)


def open_store(spark: SparkSession, path: str, seeds: Sequence[str] = (), restart: bool = False) -> DataFrame:
    """The frontier's state at ``path``. With ``restart`` what is there is dropped. An empty or
    new store is seeded; seeds are not checked for admission."""
    if restart or not exists(spark, path):
        spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    stored = spark.read.schema(SCHEMA).parquet(path)
    if stored.isEmpty() and seeds:
        first = spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, seq bigint")
        append(first.select(urls.url_hash(F.col("url")).alias("url_hash"), "url", F.lit(False).alias("completed"), "seq"), path)
        stored = spark.read.schema(SCHEMA).parquet(path)
    return frontier.state(stored)


def mark_complete(done: DataFrame, path: str) -> None:
    """Append marks (url) that the state merges; at-least-once repeats do no harm."""
    append(done.select(urls.url_hash(F.col("url")).alias("url_hash"), "url", F.lit(True).alias("completed"), F.lit((1 << 62)).cast("bigint").alias("seq")), path)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the merged state to a new place."""
    frontier.state(spark.read.schema(SCHEMA).parquet(path)).select("url_hash", "url", "completed", "seq").write.mode("overwrite").parquet(to)
