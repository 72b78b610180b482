"""Mixing sources by temperature.

A source's weight is its share of the tokens raised to an exponent, normalised. The exponent is found by bisection: the
largest one that meets a target entropy of the weights, but none that repeats a source more often than a limit. The
weights and a budget of tokens are then realised exactly: each source's documents lie in blocks, blocks are put in a
pseudo-random order, and a source gives whole passes over its blocks and a last one that stops where its budget ends.

What is decided per document follows from one row per source, so texts are not shuffled while that table is small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.llm import work

WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
STEPS = 32


@dataclass(frozen=True)
class Target:
    """`entropy` is a share of the greatest possible one, `max_repeat` the most passes over a source.

    `budget` is in tokens; None stands for all tokens of the input, and `cover` for the least budget that takes every
    document at least once.
    """

    entropy: float | None = 0.95
    max_repeat: float | None = 4.0
    budget: int | None = None
    cover: bool = False
    block_tokens: int = 200_000
    seed: int = 0


def word_count(text: Column) -> Column:
    # A letter for each word: an array of the words would take many times the text's memory.
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.char_length(F.regexp_replace(trimmed, WORD, "w")).cast("bigint")


def _at(shares: DataFrame, exponents: list[float]) -> list:
    """For each exponent the entropy of the weights, and the extremes of the ratio of weight to share."""
    grid = shares.withColumn("x", F.explode(F.array(*map(F.lit, exponents))))
    power = F.exp(F.col("x") * F.col("log_p"))
    ratio = (F.col("x") - 1) * F.col("log_p")
    return grid.groupBy("x").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("x") * F.col("log_p")).alias("e"),
        F.max(ratio).alias("most"), F.min(ratio).alias("least"),
    ).orderBy("x").select(
        "x", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"),
        (F.col("most") - F.log("z")).alias("most"), (F.col("least") - F.log("z")).alias("least"),
    ).collect()


def _bisect(shares: DataFrame, good, low_is_good: bool) -> float:
    """The border between exponents that are good and that are not, in [0, 1]; the good side of it.

    Each round halves the interval five times at once, by one aggregate over the sources.
    """
    low, high = 0.0, 1.0
    for _ in range(11):
        xs = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        fine = [good(r) for r in _at(shares, xs)]
        if all(fine):
            return high if low_is_good else low
        if not any(fine):
            return low if low_is_good else high
        k = fine.index(not low_is_good if low_is_good else True)
        low, high = xs[k - 1], xs[k]
    return low if low_is_good else high


def exponent(shares: DataFrame, n_sources: int, target: Target) -> float:
    """1 keeps the shares, 0 makes all sources equal."""
    if n_sources < 2 or target.entropy is None and target.max_repeat is None:
        return 1.0
    x = 0.0
    if target.entropy is not None:
        wanted = target.entropy * math.log(n_sources)
        x = _bisect(shares, lambda r: r["entropy"] >= wanted - 1e-12, low_is_good=True)
    if target.max_repeat is not None:
        limit = math.log(target.max_repeat) + 1e-12
        repeats = lambda r: r["most"] - (r["least"] if target.cover else 0)
        x = max(x, _bisect(shares, lambda r: repeats(r) <= limit, low_is_good=False))
    return x


def _plan(totals: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """A row (key, tokens, weight, passes, rest, blocks) for each source of (key, tokens), and the exponent."""
    everything, n_sources = totals.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    everything = everything or 0
    log_p = F.log(F.col("tokens") / F.lit(float(max(everything, 1))))
    shares = totals.where("tokens > 0").withColumn("log_p", log_p)
    x = exponent(shares, n_sources, target)
    z, passes = 1.0, 1.0
    if n_sources:
        at = _at(shares, [x])[0]
        z = shares.agg(F.sum(F.exp(F.lit(x) * F.col("log_p")))).first()[0]
        passes = math.exp(-at["least"])
    budget = everything * passes if target.cover else float(everything if target.budget is None else target.budget)

    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(x) * log_p) / F.lit(z)).otherwise(F.lit(0.0))
    # A hair more, so that a source whose budget is whole passes is not short of one by rounding.
    wanted = F.floor(F.col("weight") * F.lit(budget) + 1e-6)
    if target.cover:  # a hair is too little for sources of billions of tokens
        wanted = F.greatest(wanted, F.col("tokens"))
    plan = totals.withColumn("weight", weight).withColumn("wanted", wanted).select(
        "key", "tokens", "weight",
        F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(int(target.cover)).alias("passes"),
        F.when(F.col("tokens") > 0, F.col("wanted") % F.col("tokens")).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("bigint").alias("blocks"),
    )
    return plan, x


def mixture(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", into: str = "mix") -> DataFrame:
    """Every row with a struct (n_tokens, copies, weight, exponent) in the column `into`, which replaces one of that name.

    Tokens are words, runs without ASCII white space. `copies` says how often the mixture takes the row; 0 leaves it
    out. The tokens taken of a source fall short of weight * budget by less than its next document. A null source is
    a source; one without tokens has weight 0 and gives one copy of each row under `cover`, else none. Equal rows are
    taken together or one by one, as the budget allows, but those at the very border alike. A null or empty text has
    no tokens. An empty table gives an empty table; other columns stay as they are.
    """
    free = work.free_prefix(docs)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    doc_key = F.xxhash64(F.lit(target.seed), F.col(id_col), F.col(text_col))
    slim = work.save(docs.select(key.alias("key"), doc_key.alias("doc"), word_count(F.col(text_col)).alias("n")), "mix-rows")
    totals = work.save(slim.groupBy("key").agg(F.sum("n").alias("tokens")), "sources")
    plan, x = _plan(totals, target)
    plan = work.save(plan, "mix-plan")
    order = F.xxhash64(F.lit(target.seed), F.lit("block"), F.col("key"), F.col("block"))
    # The last pass: blocks in pseudo-random order, up to the one in which the budget ends.
    blocked = slim.join(plan, "key").withColumn("block", F.pmod("doc", "blocks"))
    blocks = blocked.groupBy("key", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("order", order)
    running = F.sum("n").over(Window.partitionBy("key").orderBy("order", "block"))
    border = blocks.withColumn("up_to", running).where("up_to > rest AND up_to - n <= rest").select(
        "key", "block", "order", (F.col("rest") - F.col("up_to") + F.col("n")).alias("left"))
    border = work.save(border, "mix-border")
    inside = blocked.select("key", "block", "doc", "n").join(border, ["key", "block"])
    inside = inside.groupBy("key", "doc", "left").agg(F.sum("n").alias("n"))
    taken = F.sum("n").over(Window.partitionBy("key").orderBy("doc"))
    last = inside.withColumn("up_to", taken).where("up_to <= left").groupBy("key").agg(F.max("doc").alias("last_doc"))
    per_source = plan.join(border.select("key", "order"), "key", "left").join(last, "key", "left")
    per_source = work.save(per_source.select(
        F.col("key").alias(free + "key"), F.col("weight").alias(free + "weight"), F.col("passes").alias(free + "passes"),
        F.col("blocks").alias(free + "blocks"), F.col("order").alias(free + "cut"), F.col("last_doc").alias(free + "last")), "mix-sources")

    here = F.pmod(free + "doc", free + "blocks")
    own = F.xxhash64(F.lit(target.seed), F.lit("block"), F.col(free + "key"), here)
    more = (own < F.col(free + "cut")) | ((own == F.col(free + "cut")) & (F.col(free + "doc") <= F.col(free + "last")))
    copies = F.col(free + "passes") + F.coalesce(more, F.lit(False)).cast("bigint")
    joined = docs.withColumns({free + "key": key, free + "doc": doc_key}).join(per_source, free + "key")
    return joined.withColumn(into, F.struct(
        word_count(F.col(text_col)).alias("n_tokens"), copies.alias("copies"), F.col(free + "weight").alias("weight"),
        F.lit(x).alias("exponent"),
    )).drop(*[free + n for n in ("key", "doc", "weight", "passes", "blocks", "cut", "last")])


def take_copies(mixed: DataFrame, column: str = "mix") -> DataFrame:
    """Each row as often as the mixture takes it, without the mixture's column."""
    names = [c for c in mixed.columns if c != column]
    times = F.explode(F.array_repeat(F.lit(1), F.col(column)["copies"].cast("int"))).alias(column)
    return mixed.select(*[F.col(f"`{n}`") for n in names], times).select(*[F.col(f"`{n}`") for n in names])
