"""Spark session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Folders are listed in shares: a task for each folder of a large tree costs more than its listing.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # Merge sessions inside each input partition before the shuffle of session windows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that can be changed on a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def builder(app: str, master: str | None = None) -> SparkSession.Builder:
    """A session builder carrying the settings; the caller adds cluster and memory options."""
    b = SparkSession.builder.appName(app)
    if master is not None:
        b = b.master(master)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names for checkpoints; `fallback` is used only when it names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return fallback


# What a task gets of a table that is spread, at most: its rows may stand for texts that take some milliseconds each.
ROWS_A_TASK = 20_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a table that comes in few files, and no task much more than `ROWS_A_TASK` rows.

    A small table is one file, hence one task. A large file is cut into many parts by its size, but the rows of a row
    group stay in one of them, often millions. A table of files enough is left as it is.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(wanted, *keys) if len(df.inputFiles()) < wanted else df
