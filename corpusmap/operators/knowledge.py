"""Learned entries, bug records and handoff notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import ellipsize, one_line
from corpusmap.operators.ranking import last_by, number_rows, top_n

# Default section and the sizes of the short lists.
DEFAULT_SECTION = "Preferences"
DO_NOT_REPEAT = "Do-Not-Repeat"
RECENT_ENTRIES, RECENT_BUGS, SEARCH_HITS, VIEW_BUGS = 10, 5, 10, 50
BUG_LINE_CHARS = 140


def append_learned(learned: DataFrame, new: DataFrame) -> DataFrame:
    """Add entries (repo, section, entry, at) behind the known ones; each becomes a single line."""
    section = F.coalesce("section", F.lit(DEFAULT_SECTION))
    lines = new.select("repo", section.alias("section"), one_line(F.col("entry")).alias("entry"), "at")
    numbered = number_rows(lines, ["repo", "section"], [F.col("at"), F.col("entry")], "n")
    last = learned.groupBy("repo", "section").agg(F.max("seq").alias("last_seq"))
    placed = numbered.join(last, ["repo", "section"], "left").select(
        "repo", "section", (F.col("n") + F.coalesce("last_seq", F.lit(0).cast("bigint"))).alias("seq"), "entry", "at"
    )
    return learned.select("repo", "section", "seq", "entry", "at").unionByName(placed)


def bug_id(number: Column, at: Column) -> Column:
    """`bug-N-` and the time in base 36."""
    millis = F.unix_millis(at.cast("timestamp")).cast("string")
    return F.concat(F.lit("bug-"), number.cast("string"), F.lit("-"), F.lower(F.conv(millis, 10, 36)))


def number_bugs(bugs: DataFrame, new: DataFrame) -> DataFrame:
    """New records (repo, error_message, fix, file, at, …) with ids that continue each repository's count."""
    order = [F.col("at"), F.col("error_message"), F.coalesce("fix", F.lit("")), F.coalesce("file", F.lit(""))]
    numbered = number_rows(new, ["repo"], order, "n")
    known = bugs.groupBy("repo").agg(F.count(F.lit(1)).alias("known"))
    total = F.col("n") + F.coalesce("known", F.lit(0).cast("bigint"))
    return (
        numbered.join(known, "repo", "left")
        .withColumn("id", bug_id(total, F.col("at")))
        .drop("n", "known")
    )


def log_bugs(bugs: DataFrame, new: DataFrame) -> DataFrame:
    """The bug table with the new records."""
    return bugs.unionByName(number_bugs(bugs, new), allowMissingColumns=True)


def latest_bugs(bugs: DataFrame, n: int) -> DataFrame:
    """The newest n records of each repository, `rank` 1 being the newest."""
    return top_n(bugs, ["repo"], [F.desc("at"), F.desc("id")], n, salt_by=["id"], rank="rank")


def search_bugs(bugs: DataFrame, term: str, limit: int = SEARCH_HITS) -> DataFrame:
    """The newest records of each repository that hold the term in error, fix or file; a blank term matches all."""
    needle = F.lit(term.lower())
    hit = (
        F.lower("error_message").contains(needle)
        | F.lower("fix").contains(needle)
        | F.lower(F.coalesce("file", F.lit(""))).contains(needle)
    )
    return latest_bugs(bugs.filter(hit), limit)


def bug_grams(bugs: DataFrame) -> DataFrame:
    """Postings (gram, repo, id): which records hold a run of three characters in error, fix or file, in lower case.

    A run is a hash, so a posting may be one too many; searches look at the texts again.
    """
    fields = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("error_message", "fix", "file")])
    chars = bugs.select("repo", "id", F.explode(fields).alias("_text")).filter(F.length("_text") > 2).select(
        "repo", "id", F.split("_text", "").alias("_chars"))
    three = lambda i: F.xxhash64(F.concat(F.get("_chars", i), F.get("_chars", i + 1), F.get("_chars", i + 2)))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_chars") - 3), three))
    return chars.select("repo", "id", F.explode(runs).alias("gram")).select("gram", "repo", "id").distinct()


def search_bug_index(
    bugs: DataFrame, grams: DataFrame, counts: DataFrame, term: str, limit: int = SEARCH_HITS, used: int = 3,
) -> DataFrame:
    """The rows of `search_bugs`, from postings and their counts (gram, n): `used` of the term's rarest runs choose records.

    Only the records that hold these runs are read through; terms of less than three characters have no run and take
    the plain way.
    """
    needle = term.lower()
    runs = {needle[i:i + 3] for i in range(len(needle) - 2)}
    if not runs:
        return search_bugs(bugs, term, limit)
    wanted = bugs.sparkSession.createDataFrame([(r,) for r in sorted(runs)], "run string").select(F.xxhash64("run").alias("gram"))
    hashes = [r["gram"] for r in wanted.collect()]  # as many as the term has characters
    sizes = {r["gram"]: r["n"] for r in counts.filter(F.col("gram").isin(hashes)).collect()}
    rarest = sorted(hashes, key=lambda h: sizes.get(h, 0))[:used]
    held = grams.filter(F.col("gram").isin(rarest)).groupBy("repo", "id").agg(F.count_distinct("gram").alias("n"))
    chosen = held.filter(F.col("n") == len(rarest)).select("repo", "id")
    return search_bugs(bugs.join(chosen, ["repo", "id"], "left_semi"), term, limit)


def recent_do_not_repeat(learned: DataFrame, n: int = RECENT_ENTRIES) -> DataFrame:
    """The newest entries of the section of mistakes, `rank` 1 being the newest."""
    return top_n(
        learned.filter(F.col("section") == DO_NOT_REPEAT), ["repo"], [F.desc("seq"), F.desc("entry")], n,
        salt_by=["seq", "entry"], rank="rank",
    )


def recent_bug_lines(bugs: DataFrame, n: int = RECENT_BUGS) -> DataFrame:
    """`error → fix` for the newest records, cut to a fixed length."""
    line = F.concat(F.col("error_message"), F.lit(" → "), F.col("fix"))
    return latest_bugs(bugs, n).select("repo", "rank", ellipsize(line, BUG_LINE_CHARS, "...").alias("line"))


def latest_handoff(handoff: DataFrame) -> DataFrame:
    """The last handoff note of each repository."""
    return handoff.groupBy("repo").agg(
        last_by("body", "at", "body").alias("body"), F.max("at").alias("at")
    )


def housekeeping(learned: DataFrame, bugs: DataFrame, repos: DataFrame) -> DataFrame:
    """Reminders for repositories with few learned entries or no bugs; repositories without need are left out."""
    entries = learned.groupBy("repo").agg(F.count(F.lit(1)).alias("entries"))
    logged = bugs.groupBy("repo").agg(F.count(F.lit(1)).alias("bugs"))
    n = F.coalesce("entries", F.lit(0).cast("bigint"))
    few = F.when(
        n < 3,
        F.concat(
            F.lit("💡 only "), n.cast("string"), F.when(n == 1, " entry").otherwise(" entries"),
            F.lit(" learned yet; add what this session shows."),
        ),
    )
    none = F.when(F.col("bugs").isNull(), "📋 no bug is on record yet.")
    return (
        repos.select("repo").join(entries, "repo", "left").join(logged, "repo", "left")
        .select("repo", F.concat_ws("\n", few, none).alias("reminders"))
        .filter(F.col("reminders") != "")
    )
