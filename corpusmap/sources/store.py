"""Keeping tables: the index, snapshots and rendered texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.operators.knowledge import bug_grams
from corpusmap.schemas import FILE_INDEX
from corpusmap.sources.documents import INDEX_VERSION


def write_index(index: DataFrame, path: str) -> None:
    """Store index rows by repository. Uneven repositories are evened out: large ones get many files."""
    (
        index.withColumn("version", F.lit(INDEX_VERSION)).hint("rebalance", "repo")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("version", "repo").parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; rows written by another version are not read."""
    stored = spark.read.schema(f"{FILE_INDEX}, version int").parquet(path)
    return stored.filter(F.col("version") == INDEX_VERSION).drop("version")


def _bucketed_name(path: str, keys: list[str], buckets: int, columns: str) -> str:
    """The catalog's name of a stored table; another place, layout or schema is another table."""
    return "corpusmap_" + hashlib.sha256(repr((path, keys, buckets, columns)).encode()).hexdigest()[:32]


def write_bucketed(df: DataFrame, path: str, buckets: int | None = None, keys: tuple[str, ...] = ("repo", "path")) -> None:
    """Store a table in buckets by a hash of its keys, one sorted file each; without a number as many as shuffles have.

    Tables with the same keys and number of buckets meet on these keys without a shuffle: drift and refresh of stored
    tables move no rows. The hash covers all keys, so a large repository spreads over all buckets and a million small
    ones make no folders. A bucket is the share of one task: choose the number for the largest of the tables that meet.
    A table cannot be written over while it is read: give each version a folder of its own. The layout is written last.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    name = _bucketed_name(path, list(keys), buckets, columns)
    (
        df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
        .bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/rows").saveAsTable(name)
    )
    layout = spark.range(1).select(
        F.lit(buckets).alias("buckets"), F.array(*[F.lit(k) for k in keys]).alias("keys"), F.lit(columns).alias("columns"))
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table stored by `write_bucketed`, also by another session: its buckets are known to joins and groupings."""
    layout = spark.read.schema("buckets int, keys array<string>, columns string").parquet(f"{path}/layout").first()
    columns = layout["columns"]
    name = _bucketed_name(path, layout["keys"], layout["buckets"], columns)
    if not spark.catalog.tableExists(name):
        keys = ", ".join(f"`{k}`" for k in layout["keys"])
        place = f"{path}/rows".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{place}'"
        )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _row_key(columns: list[str]) -> Column:
    """A hash of the named values of a row, nulls included."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])
    return F.sha2(F.concat_ws("\n", F.lit(",".join(sorted(columns))), F.to_json(row, {"ignoreNullFields": "false"})), 256)


def _ids(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, n_rows, n_changes) of the stored snapshots: one small row each."""
    schema = "snapshot_id string, n_rows bigint, n_changes bigint"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/ids")


def _stored_ids(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return []
    return [r["snapshot_id"] for r in _ids(spark, path).select("snapshot_id").collect()]


def write_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """Store a table under an id, as what changed since the snapshot before it.

    A change is (row, copies): how many copies of an equal row there are from this snapshot on, 0 when it has gone. What
    is equal costs nothing, so ten snapshots with 1% change take about 1.1 copies. The changes are written first and the
    id last, so a snapshot counts only when it is whole; writing the newest id again replaces it, and a retry does no
    harm. Ids rise: an id below the newest one is an error, as later snapshots build on what lies before them.
    """
    spark, known = df.sparkSession, _stored_ids(df.sparkSession, path)
    before = [i for i in known if i != snapshot_id]
    if before and max(before) > snapshot_id:
        raise ValueError(f"a later snapshot builds on what was before it: {max(before)}")
    columns = df.columns
    if taken := {"_key", "_copies", "snapshot_id"} & set(columns):
        raise ValueError(f"names that the store uses itself: {sorted(taken)}")
    now = df.withColumn("_key", _row_key(columns)).groupBy("_key").agg(
        F.count(F.lit(1)).alias("_copies"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row"))
    if before:
        changes = spark.read.schema("_key string, _copies bigint, snapshot_id string").parquet(
            *[f"{path}/changes/{i}" for i in before])
        last = changes.groupBy("_key").agg(F.max_by("_copies", "snapshot_id").alias("last"))
        old = last.filter("last > 0")
        now = now.join(old, "_key", "full_outer").select(
            "_key", F.coalesce("_copies", F.lit(0)).cast("bigint").alias("_copies"), "_row", "last")
        changed = now.filter("last IS NULL OR last <> _copies").drop("last")
    else:
        changed = now
    written = f"{path}/changes/{snapshot_id}"
    changed.select("_key", "_copies", F.lit(snapshot_id).alias("snapshot_id"), "_row.*").write.mode("overwrite").parquet(written)
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    n_changes = spark.read.parquet(written).agg(F.count(F.lit(1)).alias("n_changes"))
    n_rows.select(F.lit(snapshot_id).alias("snapshot_id"), "n_rows", n_changes.scalar().alias("n_changes")).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/ids/{snapshot_id}")


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the stored snapshots with their sizes, newest first: (snapshot_id, n_rows, n_changes)."""
    return _ids(spark, path).select("snapshot_id", "n_rows", "n_changes").orderBy(F.desc("snapshot_id"))


def read_snapshot(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """The newest snapshot, or the one with the given id; an unknown id is an error.

    Each row's last change up to the snapshot tells how many copies of it there are. Columns that later snapshots
    brought are null.
    """
    known = _stored_ids(spark, path)
    if not known or tag is not None and tag not in known:
        raise ValueError("no snapshots found" if tag is None else f"snapshot not found: {tag}")
    tag = max(known) if tag is None else tag
    parts = [f"{path}/changes/{i}" for i in sorted(known) if i <= tag]
    changes = spark.read.option("mergeSchema", True).parquet(*parts)
    columns = [c for c in changes.columns if c not in ("_key", "_copies", "snapshot_id")]
    state = F.struct("snapshot_id", "_copies", *[F.col(f"`{c}`") for c in columns])
    last = changes.groupBy("_key").agg(F.max_by(state, "snapshot_id").alias("s")).filter("s._copies > 0")
    rows = last.select("s", F.explode(F.sequence(F.lit(1), F.col("s._copies"))).alias("_copy"))
    return rows.select(*[F.col(f"s.`{c}`").alias(c) for c in columns])


def write_bug_index(bugs: DataFrame, path: str, append: bool = False) -> None:
    """Store postings of the records, in order of their runs, and how many each run has.

    A search for a few runs reads the row groups that hold them. With `append` the postings of new records join those
    that are there; the counts are then sums over all parts.
    """
    mode = "append" if append else "overwrite"
    bug_grams(bugs).repartitionByRange("gram").sortWithinPartitions("gram").write.mode(mode).parquet(f"{path}/grams")
    counts = bugs.sparkSession.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def read_bug_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings (gram, repo, id) and counts (gram, n)."""
    grams = spark.read.schema("gram bigint, repo string, id string").parquet(f"{path}/grams")
    return grams, spark.read.schema("gram bigint, n bigint").parquet(f"{path}/counts")


def write_rendered(rows: DataFrame, path: str, order: str = "path") -> None:
    """Store rendered texts (repo, <order>, body) by repository, in order.

    Rows are spread by ranges of (repo, order), so a large repository fills several files whose names keep
    the order.
    """
    (
        rows.repartitionByRange("repo", order).sortWithinPartitions("repo", order).select("repo", "body")
        .write.mode("overwrite").partitionBy("repo").text(path)
    )
