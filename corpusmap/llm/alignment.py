"""Alignment of two tokenizers over the bytes of texts.

Each tokenizer cuts the bytes of a text into tokens: a token-byte incidence matrix. The product of one matrix with the
other's transpose links the tokens that overlap; where tokens of both end together, groups end, and the product of the
token-group matrices links the tokens that share a group. All matrices are in compressed rows (`csr.py`).

Neither tokenizer joins what a blank separates, so a text's alignment is that of its segments one after the other. A
block of documents is written once, as numbers of segments with a table of the tokens of its distinct segments; each
segment is tokenized and multiplied once per block. A block hands Spark one row for each distinct pair of ids that it
links; the sums over the corpus come back to the block by a join. A task multiplies some segments of a block at a time,
and a file holds few blocks, so that memory follows neither the blocks of a task nor the size of their matrices.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.blocks import block_numbers, column, from_bytes, table_from_bytes, table_to_bytes, to_bytes
from corpusmap.llm.csr import Csr, ragged
from corpusmap.llm.segments import Lookup, segments
from corpusmap.llm.texts import one_array, per_text, slices

BLOCK_BYTES = 2 << 20
#: Blocks in a file: Spark reads the rows of a file in large batches, and a block is a large row.
BLOCKS_A_FILE = 4
#: Bytes of segments that are multiplied at a time; a longer segment is multiplied alone.
PART_BYTES = 1 << 17
#: Characters of words whose tokens a task keeps at a time.
WORD_CHARS = 6 << 20
LOW = np.int64((1 << 32) - 1)
Lengths = tuple[np.ndarray, np.ndarray]
ROW = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, n_best bigint, " \
      "count_sum bigint, groups string"
BLOCK = "block bigint, docs binary, codes binary, segments binary, a binary, b binary"
LINKS = "id bigint, a_place bigint, b_place bigint, a int, b int, shared bigint"


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it can be seen, else from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids of blank + segment by a byte-level BPE vocabulary, and the bytes of each id.

    A run of letters behind a blank is one piece for the vocabulary's model, as are marks behind it; such segments go
    to the model directly, all others through the whole tokenizer.
    """

    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        letters = byte_letters()
        self.letters = {ord(chr(b)): c for b, c in letters.items()}
        number = {c: b for b, c in letters.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            known = all(c in number for c in piece)
            self.pieces[i] = bytes(number[c] for c in piece) if known else piece.encode()
        self.marks: dict[str, list[int]] = {"": []}

    def _model(self, text: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def encode(self, found: list[str]) -> list[list[int]]:
        tokenize, rows = self.tokenizer.model.tokenize, []
        cores: dict[str, list[int]] = {}
        for w in found:
            m = self.SIMPLE.fullmatch(w)
            if m is None:
                rows.append(None)
                continue
            core, marks = m.groups()
            if core not in cores:
                cores[core] = [t.id for t in tokenize("Ġ" + core)] if core.isascii() else self._model(" " + core)
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": []}
                self.marks[marks] = self._model(marks)
            rows.append(cores[core] + self.marks[marks])
        other = [" " + w for w, r in zip(found, rows) if r is None]
        rest = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        return [next(rest).ids if r is None else r for r in rows]


class Pieces:
    """Ids of a segment by a sentencepiece vocabulary that puts a blank first, and the bytes of each id."""

    BYTE = re.compile("<0x([0-9A-F]{2})>")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(m.group(1), 16)]) if (m := self.BYTE.fullmatch(p)) else
                       p.replace("▁", " ").encode() for p in named]

    def encode(self, found: list[str]) -> list[list[int]]:
        return self.model.encode(found, num_threads=1)


class Spelling:
    """The bytes of the tokens of a vocabulary, to check that tokens spell blank + segment."""

    def __init__(self, encoder: ByteLevel | Pieces):
        self.bytes = np.frombuffer(b"".join(encoder.pieces), np.uint8)
        self.sizes = np.array([len(p) for p in encoder.pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def good(self, ids: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which segments have tokens (`sizes` of them, in a row) that spell their bytes (`lengths`, in a row)."""
        n_bytes = per_text(self.sizes[ids], sizes)
        good = n_bytes == lengths
        use = np.repeat(good, sizes)
        spelled = self.bytes[ragged(self.starts[ids[use]], self.sizes[ids[use]])]
        differs = spelled != wanted[np.repeat(good, lengths)]
        good[good] = per_text(differs, lengths[good]) == 0
        return good


@dataclass
class Aligned:
    """Segments one after the other: tokens (ids a and b, in how many bytes), links between them, and groups."""

    a: np.ndarray
    b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    len_a: np.ndarray
    len_b: np.ndarray
    groups_a: Csr
    groups_b: Csr

    @classmethod
    def of(cls, a: np.ndarray, sizes_a: np.ndarray, len_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray,
           len_b: np.ndarray) -> Aligned:
        ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group = lambda ends: Csr.incidence(np.ones(len(ends), np.int64), np.searchsorted(cuts, ends), len(cuts))
        return cls(a, b, sizes_a, sizes_b, len_a, len_b, group(ends_a), group(ends_b))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, shared bytes) of tokens that overlap, some at a time."""
        total = int(self.len_a.sum())
        bytes_a, bytes_b = (Csr.incidence(lengths, np.arange(total), total) for lengths in (self.len_a, self.len_b))
        return bytes_a.product_parts(bytes_b.transposed())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, 1) of tokens in the same group, some at a time."""
        return self.groups_a.product_parts(self.groups_b.transposed())

    def n_group_links(self) -> np.ndarray:
        """Links by group of each segment: the row sizes of the product, which adds nothing up."""
        return per_text(self.groups_a.product_sizes(self.groups_b.transposed()), self.sizes_a)

    def n_groups(self) -> np.ndarray:
        last = np.append(np.diff(self.groups_a.cols) != 0, True)[:len(self.a)]
        return per_text(last, self.sizes_a)

    def groups(self) -> pa.Array:
        """`a1,a2|b1;a3|b2,b3` of each segment: the rows of both transposed group matrices."""
        sides = [_joined(pa.array(ids).cast(pa.string()), matrix.transposed().sizes, ",")
                 for ids, matrix in ((self.a, self.groups_a), (self.b, self.groups_b))]
        return _joined(pc.binary_join_element_wise(*sides, "|"), self.n_groups(), ";")


def _joined(parts: pa.Array, sizes: np.ndarray, mark: str) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), parts), mark)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, pa.int32()))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


class Both:
    """Both tokenizers, as a task uses them."""

    def __init__(self, a: str, b: str):
        encoders = ByteLevel(a), Pieces(b)
        self.lookup = Lookup([e.encode for e in encoders], limit=WORD_CHARS)
        self.a, self.b = map(Spelling, encoders)

    @property
    def lengths(self) -> Lengths:
        return self.a.sizes, self.b.sizes

    def tokenized(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Segment numbers of all texts in a row, how many each has, and the table of segments: tokens a, b, good."""
        coded, sizes = segments(texts)
        spaced = pc.binary_join_element_wise("", coded.dictionary, " ")
        lengths = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
        # The bytes of all segments stand in a row already.
        wanted = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[:int(lengths.sum())]
        (a, sizes_a), (b, sizes_b) = self.lookup(coded.dictionary.to_pylist())
        good = self.a.good(a, sizes_a, wanted, lengths) & self.b.good(b, sizes_b, wanted, lengths)
        table = pa.table({
            "a": _lists(a[np.repeat(good, sizes_a)], sizes_a * good),
            "b": _lists(b[np.repeat(good, sizes_b)], sizes_b * good), "good": good,
        })
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, table


def aligned(table: pa.Table, lengths: Lengths) -> Aligned:
    """The alignment of a table of segments, given how many bytes each token of both vocabularies has."""
    (a, sizes_a), (b, sizes_b) = _flat(column(table, "a")), _flat(column(table, "b"))
    return Aligned.of(a, sizes_a, lengths[0][a], b, sizes_b, lengths[1][b])


def aligned_parts(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, lengths: Lengths,
                  max_bytes: int = PART_BYTES) -> Iterator[Aligned]:
    """The alignments of segments of some `max_bytes` bytes at a time, in order."""
    part = (np.cumsum(per_text(lengths[0][a], sizes_a)) - 1).clip(0) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes_a)]
    at_a, at_b = (np.concatenate([[0], np.cumsum(sizes)]) for sizes in (sizes_a, sizes_b))
    for x, y in zip(cuts, cuts[1:]):
        if y > x:
            ids = a[at_a[x]:at_a[y]], b[at_b[x]:at_b[y]]
            yield Aligned.of(ids[0], sizes_a[x:y], lengths[0][ids[0]], ids[1], sizes_b[x:y], lengths[1][ids[1]])


class Block:
    """The distinct segments of a written block: their alignment, and how often documents hold them."""

    def __init__(self, segments: bytes, a: bytes, b: bytes, lengths: Lengths):
        found = table_from_bytes(segments)
        of = {name: column(found, name).to_numpy(zero_copy_only=False) for name in found.column_names}
        self.good, self.times = of["good"], of["times"]
        # The segment, and the pair of ids, of each link.
        at, segment, keys = 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.parts = []
        ids = (from_bytes(x, np.int32).astype(np.int64) for x in (a, b))
        for part in aligned_parts(next(ids), of["n_a"], next(ids), of["n_b"], lengths):
            self.parts.append(part)
            n = len(part.sizes_a)
            of_token = np.repeat(np.arange(at, at + n, dtype=np.int32), part.sizes_a)
            at += n
            for row, col, _ in part.links():
                segment.append(of_token[row])
                keys.append(part.a[row] << 32 | part.b[col])
        self.segment = np.concatenate(segment)
        self.keys, self.pair = np.unique(np.concatenate(keys), return_inverse=True)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(self.pair, weights=self.times[self.segment], minlength=len(self.keys)).astype(np.int64)
        return self.keys[counts > 0], counts[counts > 0]

    def rows(self, docs: bytes, codes: bytes, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.Table:
        """The documents' rows, from the counts of all pairs that the block has sent."""
        documents, codes = table_from_bytes(docs), from_bytes(codes, np.int32)
        sizes = column(documents, "size").to_numpy(zero_copy_only=False)
        good = (per_text(~self.good[codes], sizes) == 0) & (sizes > 0)
        count, top = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        count[at], top[at] = counts, best
        n = len(self.times)
        exact = np.zeros(n, np.int64)
        np.add.at(exact, self.segment, count[self.pair])
        every = lambda value: np.concatenate([np.zeros(0, np.int64), *map(value, self.parts)])
        of_segment = {
            "n_a": every(lambda p: p.sizes_a), "n_b": every(lambda p: p.sizes_b),
            "n_groups": every(Aligned.n_groups), "n_links": np.bincount(self.segment, minlength=n),
            "n_group_links": every(Aligned.n_group_links),
            "n_best": np.bincount(self.segment, weights=top[self.pair], minlength=n).astype(np.int64),
            "count_sum": exact,
        }
        columns = {"id": column(documents, "id")} | {
            name: pa.array(per_text(values[codes], sizes) * good, pa.int64()) for name, values in of_segment.items()
        }
        used = pa.array(codes[np.repeat(good, sizes)])
        groups = pa.chunked_array([p.groups() for p in self.parts], pa.string()).combine_chunks()
        columns["groups"] = _joined(groups.take(used), sizes * good, ";")
        return pa.table(columns)


def _write_blocks(a: str, b: str, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, both = block_numbers(), Both(a, b)
        for batch in batches:
            texts = one_array(batch.column(1))
            for x, y in slices(texts, max_bytes):
                codes, sizes, table = both.tokenized(texts.slice(x, y - x))
                good = column(table, "good").to_numpy(zero_copy_only=False)
                whole = per_text(~good[codes], sizes) == 0
                (ids_a, sizes_a), (ids_b, sizes_b) = _flat(column(table, "a")), _flat(column(table, "b"))
                docs = pa.table({"id": batch.column(0).slice(x, y - x), "size": sizes})
                distinct = pa.table({"n_a": sizes_a, "n_b": sizes_b, "good": good, "times": np.bincount(
                    codes[np.repeat(whole, sizes)], minlength=len(good))})
                row = {"docs": table_to_bytes(docs), "codes": to_bytes(codes.astype(np.int32)),
                       "segments": table_to_bytes(distinct), "a": to_bytes(ids_a.astype(np.int32)),
                       "b": to_bytes(ids_b.astype(np.int32))}
                yield pa.RecordBatch.from_pydict({"block": pa.array([next(numbers)], pa.int64())} | {
                    name: pa.array([data], pa.binary()) for name, data in row.items()})

    return run


def _pairs(lengths: Lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *written in zip(*(batch.column(c).to_pylist() for c in ("block", "segments", "a", "b"))):
                keys, counts = Block(*written, lengths).pair_counts()
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(keys), number)), "pair": pa.array(keys), "n": pa.array(counts)})

    return run


def _finish(lengths: Lengths):
    def finish(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found = [answers.column(c).to_numpy() for c in ("pair", "count", "best")]
        written = zip(*(blocks.column(c).to_pylist() for c in ("docs", "codes", "segments", "a", "b")))
        return pa.concat_tables(
            [Block(*tokens, lengths).rows(docs, codes, *found) for docs, codes, *tokens in written])

    return finish


def align(
    docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row (id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups) for each row of `docs`.

    `a` is the path of a byte-level BPE vocabulary, which encodes blank + text, `b` that of a sentencepiece vocabulary,
    which adds the blank itself; driver and executors must see both. `n_links` counts pairs of tokens of a and b that share bytes,
    `n_group_links` pairs in the same group. A pair of ids counts as often as it is linked in the corpus; `count_sum`
    adds these counts up over the links, `n_best` counts links whose pair counts highest for its id of b, ties
    included. `groups` lists the ids of a and b of each group.

    Null and empty texts, and texts that one of the tokenizers does not spell byte by byte, have zeros and no groups,
    and count nothing. Each row is a document, also where ids repeat or are null; an empty table gives no rows. Of the
    columns only id and text are read. A text is taken whole, a block of its own if it is longer than `block_bytes`.
    """
    spark = docs.sparkSession
    lengths = Both(a, b).lengths  # a number for each id of both vocabularies goes to the tasks
    source = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    blocks = work.save(
        source.mapInArrow(_write_blocks(a, b, block_bytes), BLOCK), "aligned", rows_a_file=BLOCKS_A_FILE)
    tokens = blocks.select("block", "segments", "a", "b")
    pairs = work.save(tokens.mapInArrow(_pairs(lengths), "block bigint, pair bigint, n bigint"), "pairs")
    counts = work.save(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(int(LOW)))
    # A row for each id of b: never more than its vocabulary holds.
    peaks = F.broadcast(counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("peak")))
    known = counts.withColumn("b", b_id).join(peaks, "b")
    answers = pairs.select("block", "pair").join(
        known.select("pair", "count", (F.col("count") == F.col("peak")).cast("int").alias("best")), "pair")
    answers = work.load(spark, work.write(answers.select("block", "pair", "count", "best"), "pair-answers"),
                        "block bigint, pair bigint, count bigint, best int")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(lengths), ROW)


def links(docs: DataFrame, a: str, b: str, shared_groups: bool = False, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """A row (id, a_place, b_place, a, b, shared) for each link of each text; places are numbers of tokens from 0.

    Links join tokens that share bytes (`shared` of them) or, with `shared_groups`, tokens of one group. Texts as in
    `align`. Rows leave a task some at a time, also those of one long text or of one large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Both(a, b)
        for batch in batches:
            texts = one_array(batch.column(1))
            for i in range(len(texts)):
                codes, _, table = both.tokenized(texts.slice(i, 1))
                if not len(codes) or not pc.all(column(table, "good")).as_py():
                    continue
                found = aligned(table.take(pa.array(codes)).combine_chunks(), both.lengths)
                for row, col, shared in found.group_links() if shared_groups else found.links():
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array([batch.column(0)[i].as_py()] * len(row), pa.int64()), "a_place": pa.array(row),
                        "b_place": pa.array(col), "a": pa.array(found.a[row], pa.int32()),
                        "b": pa.array(found.b[col], pa.int32()), "shared": pa.array(shared),
                    })

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, LINKS)
