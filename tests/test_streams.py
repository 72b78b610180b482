"""Streams over hand-made batches: late rows, rows out of order, windows that end, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusmap.streaming import activity as W

START = dt.datetime(2026, 3, 1)
ACCESS = "session_id string, repo string, path string, op string, ts timestamp, seq bigint"


def read(session, path, hours, seq):
    return session, "r", path, "read", START + dt.timedelta(hours=hours), seq


class Feed:
    """A folder that a stream reads, one batch at a time."""

    def __init__(self, spark, root, operator, schema=ACCESS, mode="append"):
        self.spark, self.root, self.operator, self.schema, self.mode = spark, str(root), operator, schema, mode

    def put(self, rows):
        """The rows as one batch, then all that is there is read; a new query goes on from the checkpoint."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        out = self.operator(stream)
        q = out.writeStream.format("parquet").option("path", f"{self.root}/out").outputMode(self.mode).option(
            "checkpointLocation", f"{self.root}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        self.out = self.spark.read.schema(out.schema).parquet(f"{self.root}/out")
        return self

    def seqs(self):
        return sorted(r["seq"] for r in self.out.select("seq").collect())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path, W.stream_repeated_reads)


def test_windows_of_a_file(feed):
    """Reads within 24 hours of a first one repeat it; 25 hours later another window begins."""
    feed.put([read("s", "a", 0, 1), read("s", "b", 0, 2), read("t", "a", 0, 3)])
    assert feed.seqs() == []
    feed.put([read("s", "a", 23, 4), read("s", "b", 25, 5), read("t", "c", 23, 6)])
    assert feed.seqs() == [4]
    # The window of b began anew at 25 hours, that of a at the first read after 24.
    feed.put([read("s", "b", 26, 7), read("s", "a", 26, 8), read("s", "a", 49, 9), read("s", "a", 51, 10)])
    assert feed.seqs() == [4, 7, 9]


def test_late_and_unordered_rows(feed):
    feed.put([read("s", "a", 10, 2), read("s", "a", 9.5, 1), read("s", "b", 10, 3)])
    assert feed.seqs() == [2]  # ordered within a batch
    # The watermark is one hour behind 10: a row of 9.2 comes out of order but counts, one of 7 is dropped.
    feed.put([read("s", "b", 9.2, 4), read("s", "c", 7, 5), read("s", "c", 11, 6)])
    feed.put([read("s", "c", 11.5, 7)])
    assert feed.seqs() == [2, 4, 7]


def test_state_ends_with_its_window(spark, feed):
    feed.put([read("s", f"f{i}", 0, i) for i in range(40)])
    feed.put([read("t", "x", 60, 100)])
    feed.put([read("t", "x", 61, 101)])
    assert feed.seqs() == [101]
    state = spark.read.format("statestore").load(f"{feed.root}/ckpt")
    held = state.select(F.col("key.session_id").alias("s")).where("s IS NOT NULL").collect()
    assert {r.s for r in held} == {"t"}


def test_files_share_state_rows(spark, feed):
    feed.put([read("s", f"f{i}", 0, i) for i in range(500)])
    state = spark.read.format("statestore").load(f"{feed.root}/ckpt")
    assert state.count() == 16
    feed.put([read("s", f"f{i}", 1, 1000 + i) for i in range(0, 500, 2)])
    assert feed.seqs() == [1000 + i for i in range(0, 500, 2)]


def expected(rows, hours=24):
    first, out = {}, []
    for s, r, p, _, ts, seq in sorted(rows, key=lambda x: (x[4], x[5])):
        if (s, r, p) in first and ts - first[s, r, p] < dt.timedelta(hours=hours):
            out.append(seq)
        else:
            first[s, r, p] = ts
    return sorted(out)


def test_many_reads_over_days(feed):
    rng = random.Random(4)
    rows = sorted((read(rng.choice("stu"), f"f{rng.randrange(12)}", rng.uniform(0, 120), i) for i in range(600)), key=lambda r: r[4])
    for part in range(3):
        batch = rows[200 * part:200 * part + 200]
        rng.shuffle(batch)
        feed.put(batch)
    assert feed.seqs() == expected(rows)


def test_short_sessions_share_state_rows(spark, tmp_path):
    """With `shares` the state rows do not grow with the sessions; the reads that count are the same."""
    feed = Feed(spark, tmp_path, lambda s: W.stream_repeated_reads(s, shares=4))
    rng = random.Random(5)
    rows = sorted((read(rng.choice(["s", "t", None, ""]) if i % 2 else f"s{i % 40}", f"f{rng.randrange(5)}", rng.uniform(0, 90), i)
                   for i in range(600)), key=lambda r: r[4])
    for part in range(3):
        feed.put(rows[200 * part:200 * part + 200])
        assert spark.read.format("statestore").load(f"{feed.root}/ckpt").count() <= 4
    assert feed.seqs() == expected(rows)
    feed.put([read("end", "x", 200, 1000)])
    feed.put([read("end", "x", 201, 1001)])
    held = spark.read.format("statestore").load(f"{feed.root}/ckpt").select("value").toJSON().collect()
    assert "s1" not in "".join(held)


def test_late_changes_of_bursts_and_counters(spark, tmp_path):
    """Rows behind the watermark change nothing; rows out of order before it count."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    bursts = Feed(spark, tmp_path / "w1", lambda s: W.stream_change_bursts(s, "10 minutes"), "repo string, path string, ts timestamp")
    bursts.put([("r", "a", at(100)), ("r", "b", at(95)), ("r", "a", at(101))])
    bursts.put([("r", "late", at(20)), ("r", "c", at(92)), ("r", "z", at(300))])  # 20 is over an hour behind 101
    bursts.put([("q", "z", at(500))])
    got = bursts.out.orderBy("start").select("repo", "changes", "files").collect()
    assert [tuple(r) for r in got] == [("r", 4, 3), ("r", 1, 1)]
    seen = Feed(spark, tmp_path / "w5", W.stream_state_changes, "table string, mtime timestamp")
    seen.put([("t", at(100)), ("t", at(100)), ("u", at(99))])
    seen.put([("t", at(100)), ("u", at(98)), ("t", at(10))])
    assert sorted(r.mtime.minute + 60 * r.mtime.hour for r in seen.out.collect()) == [98, 99, 100]
