"""Substring dedup: repeated windows of words, with a count-min prefilter.

Each block sketches its windows: for each row of a count-min sketch the sorted cells that its windows touch. Shards of
the cell space merge the blocks' sketches and answer with one bit per touched cell: touched by more than one block. A
window counted twice or more in all rows, by its own block or by the merged sketch, is a candidate; sketches only
overestimate, so no repeated window is lost. In a second pass the blocks send the 128-bit keys of their candidates
alone, and shards of the key space find for each exact key where it starts first.

The sketch has `cells_per_window` cells per window of the corpus in each row, split over shards, so that it keeps its
power at every size and no task holds more than a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.blocks import FIRST, column, from_bytes, table_from_bytes, to_blocks, to_bytes
from corpusmap.llm.texts import covered, per_text, window_keys, windows, word_keys, words

ROWS = 2
MESSAGE = "part int, block bigint, data binary"
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("tie", "<u8")])


class Shape:
    """Bits of the cell space and of the shards, from the number of windows of the corpus."""

    def __init__(self, n_windows: int, cells_per_window: int, shard_windows: int):
        self.cell_bits = max(16, math.ceil(math.log2(max(1, n_windows * cells_per_window))))
        self.shard_bits = min(self.cell_bits - 8, max(2, math.ceil(math.log2(max(1, n_windows / shard_windows)))))
        self.shards = 1 << self.shard_bits


class Block:
    """The windows of a block and their keys."""

    def __init__(self, data: bytes, window: int):
        self.table = table_from_bytes(data)
        self.flat, self.counts = words(column(self.table, "text"))
        self.starts = windows(self.counts, window)
        keys = word_keys(self.flat)
        self.keys = [window_keys(keys, self.starts, window, seed) for seed in range(ROWS)]

    def cells(self, row: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct touched cells, each window's place among them, and how many windows touch each."""
        return np.unique(self.keys[row] >> np.uint64(64 - shape.cell_bits), return_inverse=True, return_counts=True)

    def candidates(self, shape: Shape, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows the merged sketch estimates as repeated."""
        repeated = np.ones(len(self.starts), bool)
        for row in range(ROWS):
            cells, place, times = self.cells(row, shape)
            bits = np.zeros(len(cells), bool)
            for part, a, b in _parts(cells, row, shape):
                bits[a:b] = np.unpackbits(np.frombuffer(answers[part], np.uint8), count=b - a).astype(bool)
            repeated &= ((times >= 2) | bits)[place]
        return np.flatnonzero(repeated)

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the chosen windows in order, with where each starts first; and each window's place."""
        out = np.zeros(len(chosen), ENTRY)
        out["h1"], out["h2"] = self.keys[0][chosen], self.keys[1][chosen]
        order = np.lexsort((chosen, out["h2"], out["h1"]))
        ranked = out[order]
        first = np.ones(len(order), bool)
        first[1:] = (ranked["h1"][1:] != ranked["h1"][:-1]) | (ranked["h2"][1:] != ranked["h2"][:-1])
        place = np.zeros(len(order), np.int64)
        place[order] = np.cumsum(first) - 1
        self.first_of = order[first]
        at = self.starts[chosen[self.first_of]]
        ends = np.cumsum(self.counts)
        row = np.searchsorted(ends, at, side="right")
        found = ranked[first]
        found["id"] = column(self.table, "id").fill_null(FIRST).to_numpy(zero_copy_only=False)[row]
        hashes = column(self.table, "hash").to_numpy(zero_copy_only=False)[row].astype(np.uint64)
        found["tie"] = (hashes >> np.uint64(48) << np.uint64(48)) | (at - (ends - self.counts)[row]).astype(np.uint64)
        return found, place


def _parts(cells: np.ndarray, row: int, shape: Shape):
    """(part, from, to) of the sorted cells, by shard."""
    shard = cells >> np.uint64(shape.cell_bits - shape.shard_bits)
    edges = np.searchsorted(shard, np.arange(shape.shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield row * shape.shards + s, int(edges[s]), int(edges[s + 1])


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({
        "part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()),
        "data": pa.array([r[2] for r in rows], pa.binary()),
    })


def _sketch(shape: Shape, window: int):
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                block, rows = Block(data.as_py(), window), []
                for row in range(ROWS):
                    cells = block.cells(row, shape)[0]
                    low = np.uint64((1 << (shape.cell_bits - shape.shard_bits)) - 1)
                    for part, a, b in _parts(cells, row, shape):
                        inside = cells[a:b] & low
                        rows.append((part, number, to_bytes(np.diff(inside, prepend=np.uint64(0)).astype(np.uint32))))
                yield from _messages(rows).to_batches()

    return run


def _merge_sketches(shape: Shape):
    def merge(messages: pa.Table) -> pa.Table:
        """Answers each block which of its cells another block touches too."""
        size = 1 << (shape.cell_bits - shape.shard_bits)
        once, more, all_cells = np.zeros(size, bool), np.zeros(size, bool), []
        for data in messages.column("data"):
            cells = np.cumsum(from_bytes(data.as_py(), np.uint32), dtype=np.uint64).astype(np.int64)
            more[cells] |= once[cells]
            once[cells] = True
            all_cells.append(cells)
        bits = [np.packbits(more[cells]).tobytes() for cells in all_cells]
        return messages.select(["part", "block"]).append_column("data", pa.array(bits, pa.binary()))

    return merge


def _first_starts(messages: pa.Table) -> pa.Table:
    """Answers each block which of its keys starts first in it."""
    parts = [from_bytes(d.as_py(), ENTRY) for d in messages.column("data")]
    sizes = [len(p) for p in parts]
    entries = np.concatenate(parts)
    blocks = np.repeat(messages.column("block").to_numpy(), sizes)
    order = np.lexsort((blocks, entries["tie"], entries["id"], entries["h2"], entries["h1"]))
    ranked = entries[order]
    first = np.ones(len(order), bool)
    first[1:] = (ranked["h1"][1:] != ranked["h1"][:-1]) | (ranked["h2"][1:] != ranked["h2"][:-1])
    wins = np.zeros(len(order), bool)
    wins[order[first]] = True
    bits = [np.packbits(w).tobytes() for w in np.split(wins, np.cumsum(sizes)[:-1])]
    return messages.select(["part", "block"]).append_column("data", pa.array(bits, pa.binary()))


def _key_part(h1: np.ndarray, shape: Shape) -> np.ndarray:
    return (h1 >> np.uint64(64 - shape.shard_bits)).astype(np.int64)


def _by_part(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist()))


def _candidate_keys(shape: Shape, window: int):
    def send(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, sketch = [], _by_part(answers)
        for number, data in zip(blocks.column("block").to_pylist(), blocks.column("data")):
            block = Block(data.as_py(), window)
            found, _ = block.entries(block.candidates(shape, sketch))
            edges = np.searchsorted(_key_part(found["h1"], shape), np.arange(shape.shards + 1))
            rows += [(s, number, to_bytes(found[edges[s]:edges[s + 1]])) for s in np.flatnonzero(np.diff(edges)).tolist()]
        return _messages(rows)

    return send


def _removal(shape: Shape, window: int):
    def remove(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        by_part, out = _by_part(answers), []
        for data in blocks.column("data"):
            block = Block(data.as_py(), window)
            chosen = block.candidates(shape, by_part)
            found, place = block.entries(chosen)
            wins = np.zeros(len(found), bool)
            edges = np.searchsorted(_key_part(found["h1"], shape), np.arange(shape.shards + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                bits = by_part[ROWS * shape.shards + s]
                wins[edges[s]:edges[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[s + 1] - edges[s])
            stays = np.zeros(len(chosen), bool)
            stays[block.first_of] = wins
            gone = covered(len(block.flat), block.starts[chosen[~stays]], window)
            n_removed = per_text(gone, block.counts)
            offsets = np.concatenate([[0], np.cumsum(block.counts - n_removed)]).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(offsets), block.flat.filter(pa.array(~gone)))
            out.append(pa.table({
                "id": column(block.table, "id"), "n_words": pa.array(block.counts, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pc.binary_join(kept, " "),
            }))
        return pa.concat_tables(out)

    return remove


def substring_dedup(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", cells_per_window: int = 8,
    shard_windows: int = 2_000_000,
) -> DataFrame:
    """A row (id, n_words, n_removed, kept_text) for each row of `docs`.

    A word goes if it lies in a window of `window` consecutive words whose words, in the same order, also start
    earlier: in a row with a smaller id, or earlier in the same row. Ids are integers; null comes first. Rows with the
    same id are ordered by a hash of their texts; of equal rows one counts as the earliest. Windows are judged on the
    input. kept_text joins what is left by single blanks. Null, empty and short texts have no windows; an empty table
    gives an empty table. Of the columns only id and text are read; texts are taken whole.
    """
    blocks = to_blocks(docs, window, id_col, text_col)
    n_windows = blocks.agg(F.sum("n_windows")).first()[0] or 0
    shape = Shape(n_windows, cells_per_window, shard_windows)
    sketches = blocks.select("block", "data").mapInArrow(_sketch(shape, window), MESSAGE)
    estimates = work.save(sketches.groupBy("part").applyInArrow(_merge_sketches(shape), MESSAGE), "estimates")
    both = lambda answers: blocks.groupBy("block").cogroup(answers.groupBy("block"))
    keys = both(estimates).applyInArrow(_candidate_keys(shape, window), MESSAGE)
    firsts = keys.groupBy("part").applyInArrow(_first_starts, MESSAGE)
    firsts = work.save(firsts.withColumn("part", F.col("part") + ROWS * shape.shards), "first-starts")
    return both(estimates.unionAll(firsts)).applyInArrow(
        _removal(shape, window), "id bigint, n_words bigint, n_removed bigint, kept_text string"
    )
