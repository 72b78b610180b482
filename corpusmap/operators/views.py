"""Tables for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.drift import heads_moved, staleness
from corpusmap.operators.knowledge import VIEW_BUGS, latest_bugs


def status_view(
    repos: DataFrame, scan_state: DataFrame, heads: DataFrame, sessions: DataFrame, bugs: DataFrame,
    hours: float, now: Column, budget: int = 1500,
) -> DataFrame:
    """One row per registered repository. `sessions` holds repo and session_id."""
    zero = F.lit(0).cast("bigint")
    counted = sessions.groupBy("repo").agg(F.count_distinct("session_id").alias("sessions"))
    logged = bugs.groupBy("repo").agg(F.count(F.lit(1)).alias("bugs"))
    return (
        repos.select("repo").join(scan_state, "repo", "left")
        .join(heads_moved(scan_state, heads), "repo", "left")
        .join(staleness(scan_state, heads, hours, now), "repo", "left")
        .join(counted, "repo", "left").join(logged, "repo", "left")
        .select(
            "repo", "last_scanned", F.coalesce("total_files", zero).alias("files"),
            F.coalesce("total_lines", zero).alias("lines"), "git_head",
            F.coalesce("head_moved", F.lit(False)).alias("head_moved"), F.col("reason").alias("stale_reason"),
            F.lit(budget).cast("bigint").alias("digest_budget"),
            F.coalesce("sessions", zero).alias("sessions"), F.coalesce("bugs", zero).alias("bugs"),
        )
    )


def activity_view(log_rows: DataFrame) -> DataFrame:
    """Timeline of parsed log rows; rows without a date are headings."""
    return (
        log_rows.filter(F.col("time").rlike(r"^\d{4}-\d{2}-\d{2}"))
        .select("repo", "time", "action", "files", "outcome", "tokens")
        .orderBy("repo", "time", "action", "files")
    )


def bug_view(bugs: DataFrame, n: int = VIEW_BUGS) -> DataFrame:
    """The newest records of each repository, newest first."""
    return latest_bugs(bugs, n).orderBy("repo", "rank")


def schedule_view(tasks: DataFrame) -> DataFrame:
    """The tasks with their state and last run."""
    return tasks.select(
        "repo", "id", "name", "expr", "action",
        F.when(F.col("enabled"), "enabled").otherwise("disabled").alias("state"),
        "last_run", F.coalesce("last_status", F.lit("never run")).alias("last_status"), "last_detail",
    )
