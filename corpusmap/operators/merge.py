"""Merging one knowledge store into another. Every merge can be repeated without adding anything twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import bug_key, normalize_entry, trim_space
from corpusmap.operators.knowledge import number_bugs

# The line that marks a handoff nobody has written yet, and keys of imported records with a
# column of their own.
TEMPLATE_LINE = "_Describe the next phase here; the session digest picks up this section._"
OWN_KEYS = ("error_message", "fix", "file", "timestamp", "last_seen")


def _not_known(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Source rows whose key the target does not hold; Spark splits a key with very many source rows."""
    return source.join(target.select(*on).distinct(), on, "left_anti")


def merge_learned(target: DataFrame, source: DataFrame) -> DataFrame:
    """New lines of the source by section. Both have (repo, heading, line_no, line).

    Lines are compared in normal form with the target's section of the same heading; blank lines are left out.
    """
    on = ["repo", "heading", "entry_key"]
    lines = source.filter(trim_space(F.col("line")) != "").withColumn("entry_key", normalize_entry(F.col("line")))
    known = target.withColumn("entry_key", normalize_entry(F.col("line")))
    return _not_known(lines, known, on).select("repo", "heading", "line_no", "line")


def merge_log(target: DataFrame, source: DataFrame) -> DataFrame:
    """Log rows of the source that the target does not hold. Both have (repo, row_no, row)."""
    on = ["repo", "row_key"]
    rows = source.withColumn("row_key", trim_space(F.col("row")))
    known = target.withColumn("row_key", trim_space(F.col("row")))
    return _not_known(rows, known, on).select("repo", "row_no", "row")


def merged_learned(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target's lines and the new ones, with their place: (repo, heading, place, line_no, line, added).

    `place` is (new_section, section_at, added); ordered by it and line_no, the rows of a repository make up the merged
    document: new lines stand behind their section, new sections behind all others.
    """
    key = ["repo", "heading"]
    old = target.groupBy(*key).agg(F.min("line_no").alias("old_at"))
    new = merge_learned(target, source)
    first = new.groupBy(*key).agg(F.min("line_no").alias("new_at"))
    sections = old.join(first, key, "full_outer").select(
        *key, F.col("old_at").isNull().alias("new_section"), F.coalesce("old_at", "new_at").alias("section_at"))
    rows = target.select(*key, "line_no", "line", F.lit(False).alias("added")).unionByName(
        new.withColumn("added", F.lit(True)))
    return rows.join(sections, key).select(
        *key, F.struct("new_section", "section_at", "added").alias("place"), "line_no", "line", "added")


def merged_log(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target's rows and, behind them, the new ones: ordered by (added, row_no) they make up the merged log."""
    new = merge_log(target, source).withColumn("added", F.lit(True))
    return target.select("repo", "row_no", "row", F.lit(False).alias("added")).unionByName(new)


def normalize_bugs(source: DataFrame, now: Column) -> DataFrame:
    """Imported records in the shape of the bug table. `source` has (repo, seq, fields MAP<STRING,STRING>)."""
    field = F.col("fields")
    error = trim_space(F.coalesce(field["error_message"], field["summary"], F.lit("")))
    when = F.coalesce(
        F.try_to_timestamp(field["timestamp"]).cast("timestamp_ntz"),
        F.try_to_timestamp(field["last_seen"]).cast("timestamp_ntz"), now,
    )
    extra = F.map_filter("fields", lambda k, v: ~k.isin(*OWN_KEYS))
    return source.select(
        "repo", "seq", error.alias("error_message"),
        trim_space(F.coalesce(field["fix"], F.lit(""))).alias("fix"),
        field["file"].alias("file"), when.alias("at"), extra.alias("extra"),
    )


def fresh_bugs(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source records (repo, seq, error_message, fix, file, at, …) new to the target, the first of each key.

    Equal records meet in an aggregate that combines before the shuffle, so many copies cost little.
    """
    key = bug_key(F.col("error_message"), F.col("file"))
    useful = source.filter((F.col("error_message") != "") | (F.col("fix") != ""))
    columns = [c for c in source.columns if c != "repo"]
    first = (
        useful.withColumn("bug_key", key).groupBy("repo", "bug_key")
        .agg(F.min_by(F.struct(*columns), F.struct("seq")).alias("first"))
    )
    known = target.select("repo", key.alias("bug_key")).distinct()
    return first.join(known, ["repo", "bug_key"], "left_anti").select("repo", "first.*")


def merge_bugs(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target with the records that are new to it, ids continuing its count."""
    fresh = number_bugs(target, fresh_bugs(target, source).drop("seq"))
    if "extra" in fresh.columns:
        given = F.col("extra")["id"]
        fresh = fresh.withColumn("id", F.coalesce(given, F.col("id"))).withColumn(
            "extra", F.map_filter("extra", lambda k, v: k != "id")
        )
    return target.unionByName(fresh, allowMissingColumns=True)


def merge_bugs_report(target: DataFrame, source: DataFrame) -> DataFrame:
    """Records added and skipped per repository of the source."""
    added = fresh_bugs(target, source).groupBy("repo").agg(F.count(F.lit(1)).alias("added"))
    total = source.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    n = F.coalesce("added", F.lit(0).cast("bigint"))
    return total.join(added, "repo", "left").select("repo", n.alias("added"), (F.col("total") - n).alias("skipped"))


def merge_handoff(target: DataFrame, source: DataFrame, policy: str = "auto") -> DataFrame:
    """One row per repository with the action taken and the resulting body. Both have (repo, body)."""
    if policy not in ("auto", "keep", "overwrite", "skip"):
        raise ValueError(f"unknown policy: {policy}")
    ours = target.select("repo", F.col("body").alias("ours"))
    theirs = source.select("repo", F.col("body").alias("theirs"))
    offered = trim_space(F.coalesce("theirs", F.lit(""))) != ""
    current = F.coalesce("ours", F.lit(""))
    untouched = (trim_space(current) == "") | current.contains(TEMPLATE_LINE)
    if policy == "skip":
        action = F.lit("skipped")
    elif policy == "keep":
        action = F.lit("kept")
    elif policy == "overwrite":
        action = F.when(offered, "overwritten").otherwise("missing")
    else:
        action = F.when(~offered, "missing").when(untouched, "imported").otherwise("kept")
    taken = F.col("action").isin("imported", "overwritten")
    return (
        ours.join(theirs, "repo", "full_outer")
        .withColumn("action", action)
        .select("repo", "action", F.when(taken, F.col("theirs")).otherwise(F.col("ours")).alias("body"))
    )


def merge_report(
    new_lines: DataFrame, new_rows: DataFrame, bug_counts: DataFrame, handoffs: DataFrame
) -> DataFrame:
    """What a merge changes, per repository and store; computed without writing, it is the dry run."""
    zero = F.lit(0).cast("bigint")

    def counted(df: DataFrame, store: str) -> DataFrame:
        return df.groupBy("repo").agg(F.count(F.lit(1)).alias("added")).select(
            "repo", F.lit(store).alias("store"), "added", zero.alias("skipped")
        )

    bugs = bug_counts.select("repo", F.lit("bugs").alias("store"), "added", "skipped")
    taken = F.col("action").isin("imported", "overwritten").cast("bigint")
    notes = handoffs.select("repo", F.lit("handoff").alias("store"), taken.alias("added"), (1 - taken).alias("skipped"))
    parts = counted(new_lines, "learned").unionByName(counted(new_rows, "log")).unionByName(bugs).unionByName(notes)
    return parts.withColumn("changed", F.col("added") > 0)
