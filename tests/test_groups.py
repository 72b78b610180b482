"""Helpers for hot groups give the same rows as plain windows and joins, with a third of the rows in one group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmap.operators import ranking as K


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(0 if rng.random() < 0.35 else rng.randrange(1, 40), rng.randrange(500), i) for i in range(3000)]
    return spark.createDataFrame(data, "g int, t int, i int").cache()


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_top_n(rows):
    w = Window.partitionBy("g").orderBy("t", "i")
    plain = rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 7")
    mine = K.top_n(rows, ["g"], [F.col("t"), F.col("i")], 7, ["i"], rank="rank")
    assert as_set(mine, "g", "t", "i", "rank") == as_set(plain, "g", "t", "i", "rank")
    assert K.top_n(rows, [], [F.col("i")], 5, ["i"]).count() == 5


def test_later_rows(rows):
    w = Window.partitionBy("g").orderBy("t", "i")
    plain = rows.withColumn("n", F.row_number().over(w)).filter("n > 1")
    assert as_set(K.later_rows(rows, ["g"], [F.col("t"), F.col("i")], ["i"]), "g", "i") == as_set(plain, "g", "i")


def test_running_count(rows):
    w = Window.partitionBy("g").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    odd = F.col("i") % 2 == 1
    plain = rows.withColumn("n", F.sum(odd.cast("bigint")).over(w))
    mine = K.running_count(rows, ["g"], [F.col("t"), F.col("i")], F.floor(F.col("t") / 50), odd, "n")
    assert as_set(mine, "g", "i", "n") == as_set(plain, "g", "i", "n")


def numbers_are_plain(df, keys, order):
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    mine = K.number_rows(df, keys, [F.col(c) for c in order], "n")
    assert as_set(mine, *keys, *order, "n") == as_set(plain, *keys, *order, "n") and mine.columns == plain.columns


def test_number_rows(spark, rows):
    numbers_are_plain(rows, ["g"], ["t", "i"])
    numbers_are_plain(rows.withColumn("t", F.lit(1)), ["g"], ["t", "i"])  # one time for all
    at = rows.withColumn("at", F.expr("timestamp_ntz'2026-01-01 00:00:00.123456' + make_dt_interval(0, 0, 0, t / 7)"))
    numbers_are_plain(at.withColumn("s", F.concat(F.lit('"é\n'), F.col("i").cast("string"))), ["g"], ["at", "s"])
    numbers_are_plain(rows.limit(1), ["g"], ["t", "i"])
    assert K.number_rows(rows.where("false"), ["g"], [F.col("t")], "n").count() == 0
    some = rows.withColumn("t", F.when(F.col("i") % 3 > 0, F.col("t")))
    mine = K.number_rows(some, ["g"], [F.col("t"), F.col("i")], "n")
    plain = some.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("t", "i")))
    assert sorted((r.g, r.i, r.n) for r in mine.collect()) == sorted((r.g, r.i, r.n) for r in plain.collect())
    equal = rows.where("g = 0").select("g", F.lit(1).alias("t"))  # equal in the whole order: any of them comes first
    assert [r.n for r in K.number_rows(equal, ["g"], [F.col("t")], "n").orderBy("n").collect()] == list(range(1, equal.count() + 1))


def test_one_time_spreads_evenly(spark):
    """100,000 records of one group at one time: no range holds much more than its share."""
    df = spark.range(100_000).select(F.lit("r").alias("g"), F.lit(1).alias("t"), F.sha1(F.col("id").cast("string")).alias("s"))
    key = F.struct("g", "t", "s")
    sizes = [r["count"] for r in df.groupBy(K.range_slices(df, key).alias("k")).count().collect()]
    assert len(sizes) == 256 and max(sizes) < 3 * 100_000 / 256
    small = K.range_slices(df, key, slices=4, sampled=64)
    assert df.select(small.alias("k"), "s").groupBy("k").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("k").selectExpr(
        "a > lag(b) OVER (ORDER BY k) OR k = 0 AS rises").where("NOT rises").count() == 0


def test_spread_splits_the_hot_group(rows):
    salted = rows.filter("g = 0").withColumn("s", F.pmod(F.xxhash64("i"), F.lit(K.SPREAD)))
    largest = salted.groupBy("s").count().agg(F.max("count")).first()[0]
    assert largest < rows.filter("g = 0").count() / 8
