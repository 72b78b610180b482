"""Session digests that fit a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import estimate_tokens
from corpusmap.operators.drift import staleness
from corpusmap.operators.knowledge import (
    DO_NOT_REPEAT, latest_handoff, recent_bug_lines, recent_do_not_repeat,
)
from corpusmap.sources.documents import section_of

# The heading of the section that tells the next phase.
NEXT_PHASE = r"^## 🚀"

Estimator = Callable[[Column], Column]


def prose_tokens(text: Column) -> Column:
    return estimate_tokens(text, "prose")


def _cost(text: Column, estimate: Estimator) -> Column:
    """The estimator's price; where it gives none, a quarter of the characters."""
    return F.coalesce(estimate(text).cast("bigint"), F.ceil(F.length(text) / 4.0).cast("bigint"))


def digest_sections(
    handoff: DataFrame, learned: DataFrame, bugs: DataFrame, scan_state: DataFrame
) -> DataFrame:
    """The candidate sections of each repository: (repo, prio, text), 1 being the most urgent."""
    phase = latest_handoff(handoff).select(
        "repo", F.lit(1).alias("prio"), section_of(F.col("body"), NEXT_PHASE).alias("text")
    )

    def listing(df: DataFrame, prio: int, heading: str, order: Column, line: Column) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(order.alias("order"), line.alias("line"))))
        return df.groupBy("repo").agg(
            F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("body")
        ).select("repo", F.lit(prio).alias("prio"), F.concat(F.lit(heading + "\n"), F.col("body")).alias("text"))

    mistakes = listing(
        recent_do_not_repeat(learned), 2, f"## {DO_NOT_REPEAT}", F.col("rank"),
        F.concat(F.lit("- "), F.col("entry")),
    )
    fixed = listing(
        recent_bug_lines(bugs), 3, "## Bugs with a known fix",
        -F.col("rank"), F.col("line"),
    )
    pointer = scan_state.filter(F.col("total_files") > 0).select(
        "repo", F.lit(4).alias("prio"),
        F.concat(
            F.lit("the index tracks "), F.col("total_files").cast("string"),
            F.lit(" files with what they hold and how long they are."),
        ).alias("text"),
    )
    return (
        phase.unionByName(mistakes).unionByName(fixed).unionByName(pointer).filter(F.col("text") != "")
    )


def fit_budget(sections: DataFrame, budget: int | DataFrame, estimate: Estimator = prose_tokens) -> DataFrame:
    """Join the sections of each repository in order, each only if it still fits; one too large is passed over.

    A repository has few sections (four here), so they are folded in one row. `budget` is one number or a
    table (repo, budget).
    """
    priced = sections.withColumn("cost", _cost(F.col("text"), estimate))
    rows = priced.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("prio", "text", "cost"))).alias("sections"))
    if isinstance(budget, DataFrame):
        rows = rows.join(budget.select("repo", F.col("budget").cast("bigint").alias("budget")), "repo", "inner")
    else:
        rows = rows.withColumn("budget", F.lit(budget).cast("bigint"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("used"))

    def admit(acc: Column, s: Column) -> Column:
        fits = acc["used"] + s["cost"] <= F.col("budget")
        return F.struct(
            F.when(fits, F.concat(acc["parts"], F.array(s["text"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(fits, acc["used"] + s["cost"]).otherwise(acc["used"]).alias("used"),
        )

    folded = rows.select("repo", F.aggregate("sections", start, admit).alias("r"))
    return folded.select(
        "repo", F.array_join("r.parts", "\n\n").alias("digest"), F.col("r.used").alias("tokens"),
        F.size("r.parts").alias("n_sections"),
    )


def session_digest(
    handoff: DataFrame, learned: DataFrame, bugs: DataFrame, scan_state: DataFrame,
    budget: int | DataFrame, estimate: Estimator = prose_tokens,
) -> DataFrame:
    """The digest of each repository that has anything to tell."""
    return fit_budget(digest_sections(handoff, learned, bugs, scan_state), budget, estimate)


def digest_with_warning(
    digest: DataFrame, scan_state: DataFrame, heads: DataFrame, hours: float, now: Column
) -> DataFrame:
    """The digest with a warning in front when the index is stale; the warning is outside the budget."""
    reasons = staleness(scan_state, heads, hours, now)
    body = F.coalesce("digest", F.lit(""))
    warned = F.concat(
        F.lit("⚠ the index is out of date ("), F.col("reason"), F.lit("); a refresh is due.\n\n"), body
    )
    return digest.select("repo", "digest").join(reasons, "repo", "full_outer").select(
        "repo", F.when(F.col("reason").isNotNull(), warned).otherwise(body).alias("digest")
    )
