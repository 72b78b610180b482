"""Queries that run the streams over the derived tables and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.plans import inputs as X
from corpusmap.plans import sessions as PS
from corpusmap.plans.registry import query, with_
from corpusmap.streaming import activity as W
from corpusmap.streaming import usage as U


# State rows over which a stream of many short sessions is spread.
SHARES = 256


def as_stream(df: DataFrame, root: str, batches: int = 4, files: int = 4) -> DataFrame:
    """The rows as a file stream of a few batches in order of time, with TIMESTAMP event times.

    The rows are computed once, cut at quantiles of their time, and each part is written apart as an equal number of
    files, which the stream takes up together.
    """
    for name, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    df.write.parquet(f"{root}/rows")
    df = df.sparkSession.read.schema(df.schema).parquet(f"{root}/rows")
    at = F.unix_micros("ts")
    cuts = df.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)])).first()[0]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.repartition(files).write.mode("append").parquet(f"{root}/in")
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{root}/in")


def drain(out: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it emitted."""
    if mode == "append":
        q = (
            out.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return out.sparkSession.read.schema(out.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    q = (
        out.writeStream.foreachBatch(keep).outputMode(mode)
        .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out.sparkSession.read.parquet(f"{root}/out")


def _changes(spark, sf):
    return X.access_log(spark, sf).filter("op IN ('write', 'edit')").select("repo", "path", "ts")


# Bursts are emitted once the watermark, one hour behind the last change, has passed their end.
@query("w1_stream_change_bursts", with_(X.ACCESS_SQL) + f""", c AS (
  SELECT repo, path, ts, lag(ts) OVER (PARTITION BY repo ORDER BY ts) AS prev FROM access_log WHERE op IN ('write', 'edit')), m AS (
  SELECT *, count_if(prev IS NULL OR ts >= prev + INTERVAL 1 HOUR) OVER (PARTITION BY repo ORDER BY ts) AS burst FROM c), b AS (
  SELECT repo, min(ts) AS s, max(ts) + INTERVAL 1 HOUR AS e, count(*) AS changes, count(DISTINCT path) AS files FROM m GROUP BY repo, burst)
SELECT repo, {X.sql_ts('s')} AS burst_start, {X.sql_ts('e')} AS burst_end, changes, files FROM b
WHERE e <= date_trunc('milliseconds', (SELECT max(ts) FROM c)) - INTERVAL 1 HOUR""")
def w1(spark, sf):
    root = X.work_dir(spark)
    bursts = W.stream_change_bursts(as_stream(_changes(spark, sf), root), "1 hour")
    return drain(bursts, root).select(
        "repo", X.show_ts("start").alias("burst_start"), X.show_ts("end").alias("burst_end"), "changes", "files")


@query("w2_stream_repeated_reads", with_(X.ODD_ACCESS_SQL) + f""", r AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, repo, path ORDER BY ts, seq) AS rn FROM access_log WHERE op = 'read')
SELECT session_id, repo, path, {X.sql_ts('ts')} AS ts, seq FROM r WHERE rn > 1""")
def w2(spark, sf):
    root = X.work_dir(spark)
    # Sessions are many and short here: a state row for each would call Python nearly once a read.
    repeats = W.stream_repeated_reads(as_stream(X.odd_access_log(spark, sf), root), shares=SHARES)
    return drain(repeats, root).withColumn("ts", X.show_ts("ts"))


@query("w3_stream_ledger", with_(X.USAGE_SQL, PS.LEDGER_SQL) + f"""
SELECT session_id, agent, measured_tokens, {X.sql_ts('first_seen')} AS first_seen, {X.sql_ts('"at"')} AS "at" FROM ledger""")
def w3(spark, sf):
    root = X.work_dir(spark)
    U.stream_ledger(
        as_stream(X.usage_events(spark, sf), root), f"{root}/ledger", f"{root}/ckpt", once=True
    ).awaitTermination()
    return U.read_ledger(spark, f"{root}/ledger").select(
        "session_id", "agent", "measured_tokens", X.show_ts("first_seen").alias("first_seen"),
        X.show_ts("at").alias("at"))


@query("w4_stream_action_log", with_(X.ODD_ACCESS_SQL, PS.LOG_ROWS_SQL) + "SELECT session_id, seq, row FROM log_rows")
def w4(spark, sf):
    root = X.work_dir(spark)
    W.stream_action_log(
        as_stream(X.odd_access_log(spark, sf), root), f"{root}/log", f"{root}/ckpt", once=True
    ).awaitTermination()
    return spark.read.parquet(f"{root}/log").select("session_id", "seq", "row")


@query("w5_stream_state_changes", with_(X.ACCESS_SQL) + f"""
SELECT DISTINCT repo AS "table", {X.sql_ts("date_trunc('hour', ts)")} AS mtime FROM access_log WHERE op IN ('write', 'edit')""")
def w5(spark, sf):
    """Many writes within an hour count as one change of a table."""
    root = X.work_dir(spark)
    listing = as_stream(_changes(spark, sf), root).select(
        F.col("repo").alias("table"), F.date_trunc("hour", "ts").alias("mtime"))
    return drain(W.stream_state_changes(listing), root).withColumn("mtime", X.show_ts("mtime"))


@query("w6_stream_session_counters", with_(X.ODD_ACCESS_SQL) + """
SELECT session_id, count_if(op = 'read') AS reads, count_if(op = 'write') AS writes, count_if(op = 'edit') AS edits
FROM access_log GROUP BY session_id""")
def w6(spark, sf):
    """The last state of each session and day, summed by session."""
    root = X.work_dir(spark)
    updates = drain(W.stream_session_counters(as_stream(X.odd_access_log(spark, sf), root)), root, "update")
    last = F.max_by(F.struct("reads", "writes", "edits"), "batch_id").alias("c")
    days = updates.groupBy("session_id", "day").agg(last)
    return days.groupBy("session_id").agg(*[F.sum(f"c.{n}").alias(n) for n in ("reads", "writes", "edits")])


@query("w5_watch_tables", with_(X.FILES_DOCS_SQL) + """
SELECT DISTINCT concat('repo=', repo) AS "table" FROM files_docs""")
def w5_watch(spark, sf):
    """The stream of state changes from its real source: a folder of tables, one folder per table."""
    root = X.work_dir(spark)
    X.files_docs(spark, sf).select("repo", "path", "size_bytes").write.partitionBy("repo").parquet(f"{root}/tables")
    return drain(W.stream_state_changes(W.watch_tables(spark, f"{root}/tables")), root).select("table").distinct()
