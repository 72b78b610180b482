"""Ranking and numbering of groups that may hold a large share of all rows.

Each helper works in two steps: first inside (group, slice), where the slices spread a hot group over
many tasks, then over the few rows or counts the first step leaves per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 32


def _salt(columns: Sequence[str], spread: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(spread))


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
    salt_by: Sequence[str], rank: str | None = None, spread: int = SPREAD,
) -> DataFrame:
    """The first n rows of each group in the given order; `rank` names a column for the position.

    `salt_by` names columns that vary inside a group. At most spread * n rows of a group reach its last task.
    """
    if not keys and rank is None:
        return df.orderBy(*order).limit(n)
    pos = rank or "_pos"
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = (
        df.withColumn("_salt", _salt(salt_by, spread))
        .withColumn(pos, F.row_number().over(local)).filter(F.col(pos) <= n).drop("_salt")
        .withColumn(pos, F.row_number().over(final)).filter(F.col(pos) <= n)
    )
    return kept if rank else kept.drop(pos)


def later_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt_by: Sequence[str], spread: int = SPREAD
) -> DataFrame:
    """Every row of each group except its first one.

    The rows that are not first in their slice are later rows for certain; only the slice firsts are compared.
    """
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_salt", _salt(salt_by, spread)).withColumn("_pos", F.row_number().over(local))
    sure = ranked.filter(F.col("_pos") > 1)
    contested = ranked.filter(F.col("_pos") == 1).withColumn("_pos", F.row_number().over(final))
    return sure.unionByName(contested.filter(F.col("_pos") > 1)).drop("_salt", "_pos")


def range_slices(df: DataFrame, key: Column, slices: int = 256, sampled: int = 8192) -> Column:
    """A number from 0 that never falls as `key`, a struct, grows: about as many different keys for each number.

    Bounds are picked from a sample of at most about `sampled` different keys, chosen by hash; they go through the
    driver and become a constant. Any bounds give a right order, so neither the sample nor its rounding matters to it.
    """
    n = df.count()
    wanted = int(min(1.0, sampled / max(n, 1)) * (1 << 40))
    chosen = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < wanted).distinct()
    place = lambda i: (i * F.size("ks") / slices).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("ks", place(i)))
    found = chosen.agg(F.array_sort(F.collect_list("k")).alias("ks")).select(F.array_distinct(F.array_compact(picked)).alias("b"))
    count, text = found.select(F.size("b"), F.to_json(F.struct("b"))).first()
    if not count:
        return F.lit(0)
    bounds = F.from_json(F.lit(text), found.schema)["b"]
    # Bisection: how many bounds are not above the key.
    both = F.struct(F.lit(0).alias("low"), F.lit(count).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        right = (acc["low"] < acc["high"]) & (F.get(bounds, middle) <= key)
        left = (acc["low"] < acc["high"]) & ~right
        return F.struct(F.when(right, middle + 1).otherwise(acc["low"]).alias("low"),
                        F.when(left, middle).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(count.bit_length())), both, halve, lambda acc: acc["low"])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Numbers 1, 2, 3 … inside each group, in the given rising order.

    Ranges of (group, whole order) are numbered apart and shifted by the sizes of the ranges before them, so a group of
    any size, also one with a single time, spreads over tasks. Only rows that are equal in the whole order stay together.
    """
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*map(F.col, keys), *order])])
    return running_count(df, keys, order, range_slices(df, key), F.lit(True), out)


def running_count(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: Column, when: Column, out: str
) -> DataFrame:
    """How many rows of the group up to and including this one fulfil `when`."""
    hit = when.cast("bigint")
    cut = df.withColumn("_slice", slice_by)
    by_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*keys, "_slice").agg(F.sum(hit).alias("_hits"))
        .withColumn("_shift", F.coalesce(F.sum("_hits").over(by_slice), F.lit(0).cast("bigint")))
        .drop("_hits")
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    on = [*keys, "_slice"]
    return (
        cut.withColumn("_n", F.sum(hit).over(inside))
        .join(shifts, on, "inner")
        .withColumn(out, (F.col("_n") + F.col("_shift")).cast("bigint"))
        .drop("_n", "_shift", "_slice")
    )


def last_by(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: the value of the row that is last in the order."""
    return F.max_by(value, F.struct(*order))
