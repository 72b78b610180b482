"""Packing of documents into sequences by the sum-of-squares rule.

A piece goes where the sum of the squared counts of open bins per residual gap becomes smallest; a closed bin counts
nothing. Each task packs its own pieces, a bounded window at a time. Bins that stay open hand their pieces on: to the
next window of the task, then to a smaller number of tasks, until one window holds the rest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap.llm import work
from corpusmap.llm.csr import ragged
from corpusmap.llm.segments import Lookup
from corpusmap.llm.texts import one_array, slices, words

END_ID = 1


class Encoder:
    """Token ids of texts. Each distinct word is encoded once, while a table of words lasts.

    White space never enters a token, so a text's ids are those of its words one after the other. Full stops and commas
    behind a plain letter are tokens of their own, so such a word's ids are those of what stands before and of its last
    marks; behind any other character, which may be taken apart or joined with them, the word is taken whole. Words of
    Latin letters, whose lower case and composed form are plain, go to the tokenizer's model directly.
    """

    SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    LOWER = {c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}
    #: Words from here on, in lower case as far as ASCII goes, let go of their last marks.
    PLAIN_END = r"[a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        if not isinstance(model, models.BPE) or not model.end_of_word_suffix:
            raise ValueError("a BPE vocabulary with word ends is needed")
        # The letters that stand for the bytes of the letters above.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.lookup = Lookup([self._encode])

    def _encode(self, found: list[str]) -> list[list[int]]:
        tokenize, rows = self.tokenizer.model.tokenize, []
        for w in found:
            low = w.lower() if w.isascii() else w.translate(self.LOWER)
            if self.SIMPLE.fullmatch(low):
                rows.append([t.id for t in tokenize(low if low.isascii() else low.translate(self.letters))])
            else:
                rows.append(None)
        other = [w for w, r in zip(found, rows) if r is None]
        rest = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        return [next(rest).ids if r is None else r for r in rows]

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        cores = pc.ascii_rtrim(pc.ascii_lower(chunks), ".,")
        cores = pc.if_else(pc.match_substring_regex(cores, self.PLAIN_END), cores, chunks)
        cut = pc.not_equal(pc.binary_length(cores), pc.binary_length(chunks))
        marked = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(chunks.filter(cut), "(?s)^.*[^.,]", "").dictionary_encode()
        coded = cores.dictionary_encode()
        (ids, sizes), = self.lookup(coded.dictionary.to_pylist())
        (tail_ids, tail_sizes), = self.lookup(tails.dictionary.to_pylist())
        core, tail = (x.indices.to_numpy(zero_copy_only=False) for x in (coded, tails))
        total = sizes[core]
        total[marked] += tail_sizes[tail]
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[ragged(begin, sizes[core])] = ids[ragged((np.cumsum(sizes) - sizes)[core], sizes[core])]
        out[ragged(begin[marked] + sizes[core[marked]], tail_sizes[tail])] = tail_ids[
            ragged((np.cumsum(tail_sizes) - tail_sizes)[tail], tail_sizes[tail])]
        return out, total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by END_ID, and how many each has with it."""
        flat, counts = words(texts)
        coded = flat.dictionary_encode()
        table, sizes = self.distinct(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        starts, per_word = np.cumsum(sizes) - sizes, sizes[codes]
        ids, ends = table[ragged(starts[codes], per_word)], np.cumsum(per_word)
        total = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        lengths = total[last] - total[last - counts]
        return np.insert(ids, np.cumsum(lengths), END_ID), lengths + 1


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the gap of each bin. Sizes are from 1 to capacity - 1."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; index 0 stays 0, full bins do not count
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        here = open_bins[size:capacity]
        at = np.flatnonzero(here)
        gap, change = 0, 2 * open_bins[capacity - size] + 1
        if len(at):
            changes = 2 * (open_bins[at] - here[at]) + 1 + (at > 0)
            best = int(np.argmin(changes))
            if changes[best] <= change:
                gap = size + int(at[best])
        if gap:
            b = members[gap].pop()
            open_bins[gap] -= 1
        else:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - size
        if gap > size:
            members[gap - size].append(b)
            open_bins[gap - size] += 1
    return bins, offsets, np.array(gaps, np.int64)


def _schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    fields = [T.StructField("id", id_type), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


class Packer:
    """Packs a task's pieces, `window` at a time. Bins emptier than `spare` tokens are opened again."""

    def __init__(self, capacity: int, window: int, level: int, spare: int, last: bool):
        self.capacity, self.window, self.spare, self.last = capacity, window, spare, last
        self.base, self.n = (level << 56) + (TaskContext.get().partitionId() << 32), 0
        self.rows: list[pa.Table] = []

    def _with(self, rows: pa.Table, sequence, offset) -> pa.Table:
        return rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64()))

    def _pack(self, rows: pa.Table, close: bool) -> tuple[pa.Table, pa.Table]:
        sizes = rows.column("length").to_numpy()
        order = np.argsort(-sizes, kind="stable")  # large pieces first leaves the fewest bins open
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[order], offsets[order], gaps = sum_of_squares(sizes[order], self.capacity)
        done = np.ones(len(gaps), bool) if close else gaps <= self.spare
        numbers = self.base + self.n + np.cumsum(done) - 1
        self.n += int(done.sum())
        shut = done[bins]
        mask = pa.array(shut)
        return self._with(rows.filter(mask), numbers[bins][shut], offsets[shut]), rows.filter(pc.invert(mask))

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        full = pc.equal(rows.column("length"), self.capacity)
        whole = rows.filter(full)
        if len(whole):
            yield self._with(whole, self.base + self.n + np.arange(len(whole)), np.zeros(len(whole), np.int64))
            self.n += len(whole)
        self.rows.append(rows.filter(pc.invert(full)))
        while sum(map(len, self.rows)) >= self.window:
            waiting = pa.concat_tables(self.rows)
            closed, left = self._pack(waiting.slice(0, self.window), close=False)
            if len(left) > self.window // 2:  # such pieces do not fit each other
                closed_too, left = self._pack(left, close=True)
                closed = pa.concat_tables([closed, closed_too])
            self.rows = [left, waiting.slice(self.window)]
            yield closed

    def end(self) -> Iterator[pa.Table]:
        waiting = pa.concat_tables(self.rows) if self.rows else None
        if waiting is not None and len(waiting):
            closed, left = self._pack(waiting, close=self.last)
            yield closed
            yield self._with(left, [None] * len(left), [None] * len(left))


def _to_batches(tables: Iterator[pa.Table], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for t in tables:
        if len(t):
            yield from t.select(schema.names).cast(schema).to_batches()


def _tokenized(path: str, capacity: int, window: int, spare: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        packer = Packer(capacity, window, 0, spare, last=False)

        def tables() -> Iterator[pa.Table]:
            for batch in batches:
                texts = one_array(batch.column(1))
                for a, b in slices(texts):
                    yield from packer.add(pieces(batch.column(0).slice(a, b - a), texts.slice(a, b - a)))
            yield from packer.end()

        def pieces(ids: pa.Array, texts: pa.Array) -> pa.Table:
            tokens, lengths = encoder.encode(texts)
            number = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, lengths[row] - start)
            begin = (np.cumsum(lengths) - lengths)[row] + start
            parts = [tokens[x:x + n] for x, n in zip(begin.tolist(), length.tolist())]
            columns = {
                "id": ids.take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            return pa.table(columns)

        return _to_batches(tables(), schema)

    return run


def _repacked(capacity: int, window: int, level: int, spare: int, last: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, window, level, spare, last)

        def tables() -> Iterator[pa.Table]:
            for batch in batches:
                yield from packer.add(pa.Table.from_batches([batch]).drop_columns(["sequence_id", "offset"]))
            yield from packer.end()

        return _to_batches(tables(), schema)

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    window: int = 20_000, spare: int = 8, with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document's tokens are those of its text and an end token; only documents longer than `capacity` are cut. Pieces
    of a sequence lie one after the other from offset 0. A null or empty text is its end token. Each row is a document,
    also when ids repeat or are null; an empty table gives no pieces. Of the columns only id and text are read.
    `tokenizer` is a path that all executors see. `with_ids` keeps the tokens; `sequences` then joins them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    schema = _schema(docs.schema[id_col].dataType, with_ids)
    arrow = to_arrow_schema(schema)
    source = docs.select(F.col(id_col), F.col(text_col))
    rows = work.save(source.mapInArrow(_tokenized(tokenizer, capacity, window, spare, with_ids, arrow), schema), "pieces")
    done, left, level, before = [], rows, 0, None
    while True:
        done.append(left.where(F.col("sequence_id").isNotNull()))
        waiting = left.where(F.col("sequence_id").isNull())
        n = waiting.count()
        if not n:
            break
        groups, level = -(-n // window), level + 1
        last = groups == 1 or before is not None and 2 * n > before  # or what is left hardly fits
        before = n
        # At each level a task gets a window of pieces, of which most bins close; the last window closes all.
        repacked = _repacked(capacity, 2 * window, level, spare, last, arrow)
        left = work.save(waiting.repartition(groups).mapInArrow(repacked, schema), f"pieces{level}")
        if last:
            done.append(left)
            break
    return reduce(DataFrame.unionAll, done)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed token ids: a row (sequence_id, ids) for each sequence, from pieces made `with_ids`."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten(F.col("rows.ids")).alias("ids"))
