"""The ledger as a stream: each batch adds its own part, readers fold the parts that the newest commit names.

Under the ledger's folder lie the parts, one folder each, and `_commits`: small numbered files, each a JSON object with
the live parts and their levels, and the last batch of every run. A commit is written beside and renamed, so a reader
sees the state before or after it. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmap.operators.ledger import fold_ledger, usage_rows
from corpusmap.schemas import LEDGER

FAN = 16
KEPT_COMMITS = 8


class LedgerParts:
    """The parts of one ledger. At most `fan` parts of a level are live: that many become one of the next level.

    After n batches some fan * log(n) parts are left, and a row is written again once a level. What folds replace stays
    until a later batch needs folds, for readers that began before them.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path, fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_commits/{number}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict:
        """The newest commit: number, parts (name -> level), and the last batch of each run."""
        numbers = self._commits()
        if not numbers:
            return {"number": 0, "parts": {}, "done": {}}
        return {"number": numbers[-1], **self._load(numbers[-1])}

    def live(self) -> list[str]:
        return [f"{self.path}/{name}" for name in sorted(self.state()["parts"])]

    def commit(self, state: dict) -> dict:
        """Write the state as the commit after the one it came from; old commits go."""
        number = state["number"] + 1
        done = {**state, "number": number}
        body = json.dumps({k: v for k, v in done.items() if k != "number"}, sort_keys=True)
        beside, target = (self._path(f"{self.path}/_commits/{name}") for name in (f"next-{number}", str(number)))
        out = self._fs.create(beside, True)
        out.write(bytearray(body, "utf-8"))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            raise RuntimeError(f"commit {number} of {self.path} is there already: another writer is at work")
        for old in self._commits():
            if old <= number - KEPT_COMMITS:
                self._fs.delete(self._path(f"{self.path}/_commits/{old}"), False)
        return done

    def _write(self, rows: DataFrame, name: str) -> None:
        fold_ledger(rows).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def add(self, usage: DataFrame, run: str, batch_id: int) -> None:
        """Add the usage of one batch, unless the run has added it before; then fold what has become too many."""
        state = self.state()
        if state["done"].get(run, -1) >= batch_id:
            return
        name = f"part-{run}-{batch_id}"
        self._write(usage_rows(usage), name)
        state = self.commit({
            **state, "parts": {**state["parts"], name: 0}, "done": {**state["done"], run: batch_id}})
        if self.full_level(state) is not None:
            self.sweep(state)
        while (full := self.full_level(state)) is not None:
            state = self.fold(state, full)

    def sweep(self, state: dict) -> None:
        """Remove the parts that are not live: what earlier folds replaced, and what killed runs have left."""
        for status in self._fs.listStatus(self._path(self.path)):
            found = status.getPath().getName()
            if not found.startswith("_") and found not in state["parts"]:
                self._fs.delete(status.getPath(), True)

    def full_level(self, state: dict) -> int | None:
        levels = list(state["parts"].values())
        return next((level for level in sorted(set(levels)) if levels.count(level) >= self.fan), None)

    def fold(self, state: dict, level: int) -> dict:
        """One part of the next level for all parts of a level."""
        old = sorted(name for name, at in state["parts"].items() if at == level)
        name = f"fold-{state['number'] + 1}"
        self._write(self.spark.read.schema(LEDGER).parquet(*[f"{self.path}/{n}" for n in old]), name)
        kept = {n: at for n, at in state["parts"].items() if at != level}
        return self.commit({**state, "parts": {**kept, name: level + 1}})


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of all live parts; empty when there is none."""
    parts = LedgerParts(spark, path).live()
    if not parts:
        return spark.createDataFrame([], LEDGER)
    return fold_ledger(spark.read.schema(LEDGER).parquet(*parts))


def compact_ledger(spark: SparkSession, path: str, target: str) -> None:
    """Write the folded ledger as the only part of a new folder, for a stream with a new checkpoint to go on with."""
    read_ledger(spark, path).write.parquet(f"{target}/part-compacted")
    parts = LedgerParts(spark, target)
    parts.commit({**parts.state(), "parts": {"part-compacted": 0}})


def stream_ledger(
    usage: DataFrame, path: str, checkpoint: str, once: bool = False, fan: int = FAN
) -> StreamingQuery:
    """Add usage to the ledger under `path`, one part per batch: the sums of the batch, not of the whole ledger.

    A run is named by the checkpoint folder, so a batch that runs again counts once, also after its part was folded,
    and a stream with a new checkpoint folder adds to what is there.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, batch_id: int) -> None:
        LedgerParts(batch.sparkSession, path, fan).add(batch, run, batch_id)

    trigger = {"availableNow": True} if once else {"processingTime": "2 seconds"}
    return (
        usage.writeStream.foreachBatch(add).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
