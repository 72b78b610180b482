"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A run holds (hash of a line's key, in how many documents it was found), sorted by the hash. Each batch of documents is
merge-anti-joined with the runs, which takes away keys that a run already knows as frequent, and what is left becomes
a run of its own. When a level holds `fanout` runs they are merged into one run of the next level, so a key is written
once per level and not once per batch. Hot keys cost one row per run: counts are summed inside the tasks first.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.llm import work

SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
RUN = "h1 bigint, h2 bigint, n bigint"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters unchanged."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineRuns:
    """Runs of line hashes in the shared folder. The driver holds their paths only."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]

    def _read(self, path: str) -> DataFrame:
        return work.load(self.spark, path, RUN)

    def _all(self) -> list[DataFrame]:
        return [self._read(path) for level in self.levels for path in level]

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], RUN)

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (h1, h2, n), one row per key."""
        known = reduce(DataFrame.unionAll, [r.where(F.col("n") >= self.min_docs).select(KEY) for r in self._all()],
                       self._empty().select(KEY))
        fresh = counts.join(known.hint("merge"), KEY, "left_anti") if any(self.levels) else counts
        self.levels[0].append(work.write(fresh.sortWithinPartitions(KEY), "run0"))
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                continue
            old, self.levels[k] = self.levels[k], []
            merged = self._merge([self._read(p) for p in old]).sortWithinPartitions(KEY)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(work.write(merged, f"run{k + 1}"))
            for path in old:
                work.remove(self.spark, path)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy(KEY).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """Keys found in at least `min_docs` documents: one that any run knows as such, or by the sum of the runs."""
        runs = self._all()
        return (self._merge(runs) if runs else self._empty()).where(F.col("n") >= self.min_docs).select(KEY)


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 4,
    id_col: str = "doc_id", text_col: str = "text", into: str = "lines",
) -> DataFrame:
    """Every row, with a struct (text, n_lines, n_dropped) in the column `into`, which replaces one of that name.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least
    `min_chars` code points found in at least `min_docs` rows lose all their lines in all texts; a line found often in
    one text counts once. A null or empty text is one empty line and gives an empty text. Each row is a document, also
    when rows or ids repeat or an id is null. An empty table gives an empty table; other columns stay as they are.
    """
    spark, free = docs.sparkSession, work.free_prefix(docs)
    k1, k2, fallen = (free + n for n in ("k1", "k2", "drops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Names the row for the join back: the same lines fall from rows with the same id and text.
    ids = [F.xxhash64(F.col(id_col), text).alias(k1), F.xxhash64(F.lit("text"), text).alias(k2)]
    keyed = docs.select(*ids, F.transform(F.split(text, "\n"), line_key).alias("keys"))
    long_enough = lambda k: F.when(F.char_length(k) >= min_chars, _hash(k))
    keys = keyed.select(
        k1, k2, F.transform("keys", long_enough).alias("lines"),
        F.transform(F.filter(F.array_distinct("keys"), lambda k: F.char_length(k) >= min_chars), _hash).alias("once"),
        F.pmod(F.col(k1), F.lit(batches)).cast("int").alias("batch"),
    )
    path = work.new_path(spark, "line-keys")
    with work.tidy(spark):
        keys.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(keys.schema).parquet(path)

    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        once = stored.where(F.col("batch") == b).select(F.explode("once").alias("h")).select("h.h1", "h.h2")
        runs.add(once.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")))

    found = stored.select(k1, k2, F.posexplode("lines").alias("at", "h")).where(F.col("h").isNotNull())
    # A written table: the join's side is then a plain scan, and Spark can split a hot line's rows over many tasks.
    frequent = work.save(runs.frequent(), "frequent")
    drops = (
        found.select(k1, k2, "at", "h.h1", "h.h2").join(frequent, KEY, "left_semi")
        .groupBy(k1, k2).agg(F.collect_set("at").alias(fallen))
    )

    def without(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(fallen))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col(fallen).isNull(), text).otherwise(let(F.split(text, "\n"), without))
    n_lines = F.size(F.split(text, "\n")).cast("bigint")
    n_dropped = F.coalesce(F.size(fallen), F.lit(0)).cast("bigint")
    joined = docs.withColumns({k1: ids[0], k2: ids[1]}).join(drops, [k1, k2], "left")
    return joined.withColumn(
        into, F.struct(kept.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
    ).drop(k1, k2, fallen)
