"""Blocks of documents, and messages between blocks and shards of a key space.

A block is one row that holds some megabytes of documents as a compressed Arrow table. Blocks are written once, so that
every later pass sees the same rows in the same order. A block sends each shard of the key space one message with its
distinct keys in order; the shard answers with a bit (or a number) for each key of the message. A key that is hot costs
one entry per block, and no table has to fit in a task or in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.texts import one_array, slices, words

BLOCK_BYTES = 8 << 20
FIRST = np.iinfo(np.int64).min


def to_bytes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; the high planes of small numbers vanish."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def from_bytes(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = planes.reshape(dtype.itemsize, len(planes) // dtype.itemsize)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def table_to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def table_from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    values = table.column(name)
    return values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)


def block_numbers() -> Iterator[int]:
    """Numbers for the blocks of a task, the same when the task runs again."""
    base, n = TaskContext.get().partitionId() << 32, 0
    while True:
        yield base + n
        n += 1


def in_order(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by id (null first) and a hash of the text, and that hash in this order."""
    values = ids.fill_null(FIRST).to_numpy(zero_copy_only=False)
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
    order = np.lexsort((hashes, values, ids.is_valid().to_numpy(zero_copy_only=False)))
    return order, hashes[order]


def to_blocks(docs: DataFrame, window: int, id_col: str, text_col: str, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written blocks (block, n_windows, data): data holds id, text and hash, rows in the order of `in_order`.

    `n_windows` counts the runs of `window` words of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers()
        for batch in batches:
            texts = one_array(batch.column(1))
            for a, b in slices(texts, max_bytes):
                ids, part = batch.column(0).slice(a, b - a), texts.slice(a, b - a)
                order, hashes = in_order(ids, part)
                taken = pa.array(order)
                part = part.take(taken)
                _, counts = words(part)
                data = table_to_bytes(pa.table({"id": ids.take(taken), "text": part, "hash": hashes}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(numbers)], pa.int64()),
                     pa.array([int(np.maximum(counts - window + 1, 0).sum())], pa.int64()), pa.array([data], pa.binary())],
                    names=["block", "n_windows", "data"],
                )

    source = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    return work.save(source.mapInArrow(run, "block bigint, n_windows bigint, data binary"), "blocks")
