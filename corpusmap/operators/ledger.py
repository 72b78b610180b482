"""Token usage per session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import usage_total
from corpusmap.operators.ranking import top_n

# Fixed value: the budget of a digest when nothing else is configured.
DEFAULT_BUDGET = 1500


def measured_usage(usage: DataFrame) -> DataFrame:
    """Usage events with their total in `measured_tokens`."""
    return usage.withColumn(
        "measured_tokens",
        usage_total(*[F.col(c) for c in (
            "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "meter_tokens")]),
    )


def usage_rows(usage: DataFrame) -> DataFrame:
    """Usage events as ledger rows, one per event."""
    return measured_usage(usage).select(
        "session_id", "agent", "measured_tokens", F.lit(None).cast("bigint").alias("estimated_tokens"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("at"), F.col("seq").cast("bigint").alias("seq"),
    )


def fold_ledger(rows: DataFrame) -> DataFrame:
    """One row per session: its latest value by time and sequence number, the latest agent known, the earliest sight.

    The result does not depend on how the rows were cut into batches.
    """
    moment = F.struct("at", "seq")
    return rows.groupBy("session_id").agg(
        F.max_by("agent", F.when(F.col("agent").isNotNull(), moment)).alias("agent"),
        F.max_by("measured_tokens", moment).alias("measured_tokens"),
        F.max("estimated_tokens").alias("estimated_tokens"),
        F.min("first_seen").alias("first_seen"),
        F.max(moment).alias("last"),
    ).select(
        "session_id", "agent", "measured_tokens", "estimated_tokens", "first_seen",
        F.col("last.at").alias("at"), F.col("last.seq").alias("seq"),
    )


def ledger_upsert(ledger: DataFrame, usage: DataFrame) -> DataFrame:
    """The ledger after new usage: the latest value of each session wins, a missing agent keeps the known one.

    One aggregate over old rows and new events; both sides combine before the shuffle. A ledger without `seq`
    counts as older than events of the same time.
    """
    seq = F.coalesce("seq", F.lit(-1)) if "seq" in ledger.columns else F.lit(-1)
    old = ledger.withColumn("seq", seq.cast("bigint"))
    new = usage_rows(usage)
    return fold_ledger(old.select(*new.columns).unionByName(new))


def ledger_cap(ledger: DataFrame, rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """The newest sessions by first sight, of the whole ledger or of each group: for reports, not for storing."""
    order = [F.desc("first_seen"), F.desc("session_id")]
    return top_n(ledger, list(keys), order, rows, salt_by=["session_id"])


def lifetime_sessions(ledger: DataFrame) -> DataFrame:
    """Number of sessions ever seen; the stored ledger keeps all of them."""
    return ledger.agg(F.count_distinct("session_id").alias("total_sessions"))


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Sessions and summed tokens."""
    zero = F.lit(0).cast("bigint")
    return ledger.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("measured_tokens"), zero).alias("measured_tokens"),
        F.coalesce(F.sum("estimated_tokens"), zero).alias("estimated_tokens"),
    )


def usage_report(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The latest n sessions, each beside the totals of the whole ledger."""
    totals = usage_totals(ledger)
    names = {"sessions": "all_sessions", "measured_tokens": "all_measured", "estimated_tokens": "all_estimated"}
    return ledger_cap(ledger, n).select("*", *[totals.select(c).scalar().alias(to) for c, to in names.items()])


def digest_budget(agents: DataFrame, default: int | None = None, budgets: Mapping[str, int] | None = None) -> DataFrame:
    """Budget per agent: its own, else the configured default, else the built-in one. `agents` has `agent`."""
    fallback = F.lit(default if default is not None else DEFAULT_BUDGET).cast("bigint")
    if not budgets:
        return agents.withColumn("budget", fallback)
    table = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    return agents.withColumn("budget", F.coalesce(table[F.col("agent")].cast("bigint"), fallback))
