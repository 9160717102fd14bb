"""The page log: JSON lines per host, written once per fetched page and replayed on start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import simhash, text, urls

SCHEMA = T.StructType(
    [
        T.StructField("fetch_url", T.StringType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("bucket_keys", T.ArrayType(T.StringType())),
        T.StructField("simhash", T.DecimalType(20, 0)),
        T.StructField("fetched_at", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)


#: Records with this column set are malformed.
_BAD = "_malformed"


def read(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of all ``*.json*`` files with ``file`` and ``seq``; blank and malformed lines are
    skipped. ``seq`` rises in the order of file paths and of lines within a file, from 0.

    Files are read in any order and in pieces: a line's number is the number of lines in earlier
    pieces (one small row per piece) and its place in its own, so no sort of the log is needed.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(directory)
    piece = ["_file", "_start"]
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    )
    sizes = placed.groupBy(*piece).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)  # one row per piece of a file
    offsets = sizes.select(*piece, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    schema = T.StructType([*SCHEMA.fields, T.StructField(_BAD, T.StringType())])
    parsed = placed.where(F.trim("value") != "").withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    good = parsed.where(F.col("_r").isNotNull() & F.col(f"_r.{_BAD}").isNull())
    joined = good.join(offsets, piece)
    return joined.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in SCHEMA.fields], F.col("_file").alias("file"), (F.col("_at") + F.col("_shift")).alias("seq"))


def write(pages: DataFrame, directory: str) -> None:
    """Append pages (url, text, simhash signed, fetched_at) as JSON lines by host. The URL is
    normalised again, and pages without a host are dropped."""
    n = pages.withColumn("n", urls.normalized(F.col("url"))).where("n.netloc is not null")
    rows = n.select(
        F.col("n.netloc").alias("host"),
        "n.fetch_url",
        "n.dedup_key",
        "n.bucket_keys",
        simhash.to_unsigned(F.col("simhash")).alias("simhash"),
        "fetched_at",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # One writer a host and batch, so hosts don't scatter over many small files.
    rows.repartition("host").write.mode("append").partitionBy("host").json(directory)


def replay(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Page events (host, pattern, seq, status, simhash, n_features) of logged rows.

    Rows without a valid URL are skipped. A missing SimHash is computed from the text; where
    that is empty too, the row is only a seen path and gives an event without a page. Missing
    bucket keys are computed from the URL. Statuses are not logged, so ``status`` is null.
    """
    n = log.select(F.col(seq).alias("seq"), "simhash", "bucket_keys", F.coalesce("text", F.lit("")).alias("text"), urls.normalized(F.col("fetch_url")).alias("n"))
    known = n.where("n.netloc is not null").select(
        "seq",
        F.col("n.netloc").alias("host"),
        F.col("n.dedup_key").alias("dedup_key"),
        F.when(F.size(F.coalesce("bucket_keys", F.array().cast("array<string>"))) > 0, F.col("bucket_keys")).otherwise(F.col("n.bucket_keys")).alias("keys"),
        simhash.from_unsigned(F.col("simhash")).alias("logged"),
        "text",
    )
    # Only texts without a logged hash go through the hash function.
    need = F.when(F.col("logged").isNull() & (F.col("text") != ""), F.col("text"))
    hashed = F.coalesce("logged", F.when(need.isNotNull(), simhash.text_simhash(need)))
    return known.select(
        "host",
        F.explode("keys").alias("pattern"),
        "seq",
        F.lit(None).cast("int").alias("status"),
        hashed.alias("simhash"),
        F.size(text.features(F.col("text"))).alias("n_features"),
        "dedup_key",
    )


def replayed_rows(log: DataFrame) -> int:
    return log.where(urls.is_valid(F.col("fetch_url"))).count()
