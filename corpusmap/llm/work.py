"""Where jobs cut their lineage: tables written to the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: While this module writes: shuffle files go with their query, and Python tasks get their rows in small batches.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
#: For tables of long texts: what Spark's reader, the Arrow buffers of Python tasks, a row group and a page of it hold.
LONG_TEXTS = {
    "spark.sql.parquet.columnarReaderBatchSize": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
    "parquet.block.size": str(4 << 20),
    "parquet.page.size": str(256 << 10),
}
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = path = tempfile.mkdtemp(prefix="corpusmap-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _local[sc.applicationId]


def for_long_texts(spark: SparkSession) -> None:
    """From now on `LONG_TEXTS` holds, also when the caller writes what a step returns."""
    for key, value in LONG_TEXTS.items():
        spark.conf.set(key, value)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, `SETTINGS` hold; the smaller batches for long texts stay."""
    before = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        if before[key] != LONG_TEXTS.get(key):
            spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def free_prefix(df: DataFrame) -> str:
    """Underscores with which no column of the table begins, for columns that are added for a while."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def hash_share(key: Column, wanted: int, of: int) -> Column:
    """Rows whose hash lies in a share that holds `wanted` of `of` rows or, by chance alone, a few less.

    Taken before an exact limit, it keeps what tasks hand over for the limit from growing with their number.
    """
    share = min(1.0, (2 * wanted + 100) / max(of, 1))
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1 << 40)) < int(share * (1 << 40))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/corpusmap-llm/{uuid.uuid4().hex}-{name}"


def save(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps survive lost executors."""
    return load(df.sparkSession, write(df, name, rows_a_file), df.schema)


def write(df: DataFrame, name: str, rows_a_file: int = 0) -> str:
    """Where the table now is. A file holds `rows_a_file` rows at most, if that is not 0."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return path


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
