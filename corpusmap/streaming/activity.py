"""Streams of file changes, reads and writes.

Event times must be TIMESTAMP. Rows later than the watermark are dropped where an operator has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmap.functions.paths import to_posix
from corpusmap.operators.access import action_log
from corpusmap.operators.filters import loggable_events

WATERMARK = "1 hour"
FORGET_HOURS = 24


def stream_change_bursts(changes: DataFrame, gap: str = "1 second", watermark: str = WATERMARK) -> DataFrame:
    """Changes (repo, path, ts) -> one row per burst of a repository, when `gap` has passed without a change."""
    return (
        changes.withWatermark("ts", watermark)
        .groupBy("repo", F.session_window("ts", gap).alias("burst"))
        .agg(F.count(F.lit(1)).alias("changes"), F.size(F.collect_set("path")).cast("bigint").alias("files"))
        .select("repo", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "changes", "files")
    )


REPEATS = "session_id string, repo string, path string, ts timestamp, seq bigint"


FIRSTS = "files array<string>, first_us array<bigint>"


def _later_reads(hours: int):
    """The state function of one share of the files: for each `file` the first read of its window."""
    window = pd.Timedelta(hours=hours)

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files, times = state.get if state.exists else ((), ())
        firsts = pd.Series(pd.to_datetime(list(times), unit="us"), index=pd.Index(list(files), dtype=object))
        if not state.hasTimedOut:
            reads = pd.concat(batches, ignore_index=True).sort_values(["file", "ts", "seq"], ignore_index=True)
            repeats = []
            while len(reads):
                # Files without a window begin one with their first read; what lies beyond a window begins the next.
                opening = ~reads["file"].isin(firsts.index) & ~reads["file"].duplicated()
                firsts = pd.concat([firsts, reads[opening].set_index("file")["ts"]])
                near = reads["ts"] - reads["file"].map(firsts) < window
                repeats.append(reads[near & ~opening])
                reads = reads[~near]
                firsts = firsts.drop(reads["file"].unique())
            yield pd.concat(repeats)[["session_id", "repo", "path", "ts", "seq"]]
        # Rows behind the watermark are dropped, so no read meets a window that ended before it.
        mark_ms = state.getCurrentWatermarkMs()
        firsts = firsts[firsts + window > pd.Timestamp(mark_ms, unit="ms")]
        if not len(firsts):
            if state.exists:
                state.remove()
            return
        state.update((list(firsts.index), [int(t.value // 1000) for t in firsts]))
        end_ms = int((firsts.min() + window).value // 1_000_000)
        state.setTimeoutTimestamp(max(end_ms, mark_ms + 1))

    return emit


def stream_repeated_reads(
    access: DataFrame, hours: int = FORGET_HOURS, watermark: str = WATERMARK, buckets: int = 16, shares: int | None = None,
) -> DataFrame:
    """Reads of a file that its session has read before, unless that is longer ago than `hours`.

    A state row holds the first reads of one of `buckets` shares of the files of a (session, repo), so a busy session is
    spread over tasks and Python is called once per share and batch, not per file. Where sessions are many and small, give
    `shares`: the files of all sessions are dealt into as many state rows, and the calls do not grow with the sessions.
    A file leaves the state when the watermark has passed the end of its window. `buckets` and `shares` must stay the
    same for the life of a checkpoint.
    """
    reads = (
        loggable_events(access).withWatermark("ts", watermark).filter(F.col("op") == "read")
        .select("session_id", "repo", to_posix(F.col("path")).alias("path"), "ts", "seq")
    )
    if shares is None:
        keys = ["session_id", "repo", "bucket"]
        dealt = reads.withColumns({"file": F.col("path"), "bucket": F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")})
    else:
        keys, whole = ["share"], ["session_id", "repo", "path"]
        dealt = reads.withColumns({
            "file": F.to_json(F.struct(*whole)), "share": F.pmod(F.xxhash64(*whole), F.lit(shares)).cast("int")})
    return dealt.groupBy(*keys).applyInPandasWithState(
        _later_reads(hours), REPEATS, FIRSTS, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_action_log(access: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append log rows of writes and edits to Parquet files, every two seconds, or all that is there now."""
    rows = action_log(loggable_events(access))
    trigger = {"availableNow": True} if once else {"processingTime": "2 seconds"}
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def watch_tables(spark: SparkSession, root: str) -> DataFrame:
    """The files that appear below a folder of tables, one folder per table: (table, mtime)."""
    files = spark.readStream.schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    ).format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/*")
    table = F.element_at(F.split("path", "/"), -2)
    return files.select(table.alias("table"), F.col("modificationTime").alias("mtime"))


def stream_state_changes(listing: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Files of tables (table, mtime) -> one event per table and time at which it changed."""
    return listing.withWatermark("mtime", watermark).dropDuplicatesWithinWatermark(["table", "mtime"])


def stream_session_counters(access: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Running counts per session and day (UTC); for update mode. Counts combine before the shuffle.

    A day's state leaves when the watermark has passed its end; the counts of a session are the sums of its days.
    """
    return loggable_events(access).withWatermark("ts", watermark).groupBy(
        "session_id", F.window("ts", "1 day").alias("day")
    ).agg(
        F.count_if(F.col("op") == "read").alias("reads"),
        F.count_if(F.col("op") == "write").alias("writes"),
        F.count_if(F.col("op") == "edit").alias("edits"),
    ).select("session_id", F.col("day.start").alias("day"), "reads", "writes", "edits")
