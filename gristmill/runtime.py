"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, name: str = "gristmill", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, bench) is a
    temporary folder set; on a cluster without the setting Spark itself refuses to
    checkpoint, which is wanted: a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably (checkpoint in the shared folder) and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of checkpoints; without one (a cluster that names none) this fails."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    if shared is None:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{shared}/{name}-{uuid.uuid4()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``key`` and the seed, so alike on every run.

    A first cut by the hash keeps about half as many again as are wanted, so the sort behind the
    limit sees a bounded number of rows, however many partitions there are.
    """
    total = df.count()
    rank = F.xxhash64(F.lit(seed), F.col(key))
    if total > 2 * n:
        parts = 1 << 40
        df = df.where(F.pmod(rank, F.lit(parts)) < int(parts * min(1.0, (1.5 * n + 100) / total)))
    return df.orderBy(rank, key).limit(n)
