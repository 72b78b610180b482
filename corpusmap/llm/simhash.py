"""SimHash fingerprints of documents, and the search for fingerprints within a Hamming radius.

The terms of a text are its words and its pairs of neighbouring words; a term weighs one more than the logarithm of its
count. Each term's hash votes with its weight on every bit, and the sign of the sum is the bit.

Fingerprints within radius r of each other differ in at most r of their blocks, so they agree in the others. For each
choice of that many blocks a table is keyed by these blocks, as if the bits were permuted to bring them to the front.
Fingerprints that meet under a key are compared; a pair counts in the first table in which it meets, so that none
counts twice. A key with many fingerprints is split into tiles, which compare it part by part in separate tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.ordered import each_with_next
from corpusmap.llm.texts import mix, one_array, slices, word_keys, words

BITS = 128
WORDS = BITS // 64
SLICE_BYTES = 2 << 20
#: For each byte, its bits as counters of 16 bits, four in each of two numbers.
LANES = np.array([[sum(((v >> (4 * half + i)) & 1) << (16 * i) for i in range(4)) for v in range(256)]
                  for half in range(2)], np.uint64)
#: So many terms of one text add up before a counter of 16 bits could run over (a term weighs 63 at most).
CHUNK = 1024
#: Bits of a term's hash that stand beside the number of its text in one number, so that terms sort as numbers.
HASH_BITS = 43
MAX_ROWS = 1 << (64 - HASH_BITS)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of all texts in a row: their hashes, weights, and how many each text has."""
    flat, counts = words(texts, lower=True)
    keys = word_keys(flat)
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    inside = row[1:] == row[:-1]
    pairs = mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + keys[1:])[inside]
    room, low = np.uint64(HASH_BITS), np.uint64(64 - HASH_BITS)
    both = np.concatenate([(row << room) | (keys >> low), (row[1:][inside] << room) | (pairs >> low)])
    both.sort()
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
    times = np.diff(np.append(first, len(both)))
    weights = 1 + np.floor(np.log2(np.maximum(times, 1))).astype(np.uint64)
    both = both[first]
    per_text = np.bincount((both >> room).astype(np.int64), minlength=len(counts))
    return mix(both & np.uint64((1 << HASH_BITS) - 1)), weights, per_text


def _ones(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each chunk of terms the weights that vote for each bit of `keys`."""
    out = np.empty((len(starts), 64), np.int64)
    for byte, values in enumerate(keys.view(np.uint8).reshape(-1, 8).T):
        for half in range(2):
            sums = np.add.reduceat(LANES[half][values] * weights, starts)
            at = 8 * byte + 4 * half
            out[:, at:at + 4] = sums.view(np.uint16).reshape(len(starts), 4)
    return out


def fingerprint_words(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text as a row of 64-bit numbers, the lowest bits first; 0 where there are no words."""
    keys, weights, counts = terms(texts)
    out = np.zeros((len(counts), WORDS), np.uint64)
    if not len(keys):
        return out
    n_chunks = -(-counts // CHUNK)
    text = np.repeat(np.arange(len(counts)), n_chunks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    starts = (np.cumsum(counts) - counts)[text] + place * CHUNK
    some, firsts = np.flatnonzero(counts), (np.cumsum(n_chunks) - n_chunks)[counts > 0]
    totals = np.add.reduceat(weights.astype(np.int64), starts[firsts])
    for w in range(WORDS):
        ones = np.add.reduceat(_ones(mix(keys + np.uint64(w)), weights, starts), firsts, axis=0)
        bits = 2 * ones > totals[:, None]
        out[some, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """As `fingerprint_words`, for any number of texts, some at a time."""
    parts = [fingerprint_words(texts.slice(x, min(MAX_ROWS - 1, b - x)))
             for a, b in slices(texts, SLICE_BYTES) for x in range(a, b, MAX_ROWS - 1)]
    return np.concatenate(parts) if parts else np.zeros((0, WORDS), np.uint64)


def as_hex(rows: np.ndarray) -> pa.Array:
    """Fingerprints as strings of hexadecimal digits, the highest bits first."""
    return pa.array([f"{high:016x}{low:016x}" for low, high in rows.tolist()], pa.string())


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text as 32 hexadecimal digits. Equal texts have equal fingerprints; null counts as empty."""

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        return as_hex(fingerprints(one_array(texts)))

    return found(text)


def with_fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """Every row with its fingerprint in the column `into`, which replaces one of that name.

    Words are runs of characters other than ASCII white space, A-Z in lower case. A null, empty or blank text has the
    fingerprint of no terms, all zeros; equal rows have equal fingerprints; an empty table stays empty; other columns
    stay as they are. Texts are taken whole.
    """
    return docs.withColumn(into, fingerprint(F.col(text_col)))


def halves(digits: Column) -> tuple[Column, Column]:
    """The high and the low half of a fingerprint as longs."""
    as_long = lambda start: F.conv(F.substring(digits, start, 16), 16, -10).cast("bigint")
    return as_long(1), as_long(17)


def distance(a: Column, b: Column) -> Column:
    """In how many bits two fingerprints differ."""
    (a_high, a_low), (b_high, b_low) = halves(a), halves(b)
    return F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree: from 0 to 1, about one half for unrelated texts."""
    return 1 - distance(a, b) / F.lit(float(BITS))


@dataclass(frozen=True)
class Tables:
    """Fingerprints within `radius` bits are found, by tables over `blocks` blocks of equal width.

    A key under which more than `tile` fingerprints stand is split into tiles.
    """

    radius: int = 6
    blocks: int = 8
    tile: int = 2048

    def __post_init__(self):
        if BITS % self.blocks or 64 % (BITS // self.blocks) or not 0 <= self.radius < self.blocks:
            raise ValueError("blocks of equal width within 64 bits, and more of them than the radius, are needed")

    @property
    def width(self) -> int:
        return BITS // self.blocks

    def chosen(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.blocks), self.blocks - self.radius))

    def first_table(self) -> np.ndarray:
        """For each set of equal blocks, as bits, the first table whose blocks are all among them; -1 if none is."""
        out = np.full(1 << self.blocks, -1, np.int64)
        for number, some in reversed(list(enumerate(self.chosen()))):
            bits = sum(1 << b for b in some)
            out[(np.arange(len(out)) & bits) == bits] = number
        return out


def _posted(found: DataFrame, tables: Tables) -> DataFrame:
    """Each fingerprint (high, low) under its key in each table, once for each tile that compares it."""
    per_half, mask = 64 // tables.width, (1 << tables.width) - 1
    block = lambda i: F.shiftrightunsigned("low" if i < per_half else "high", (i % per_half) * tables.width).bitwiseAND(
        F.lit(mask if tables.width < 64 else -1))
    keys = F.array(*[F.struct(F.lit(n).alias("number"), F.xxhash64(F.lit(n), *map(block, some)).alias("key"))
                     for n, some in enumerate(tables.chosen())])
    rows = found.select("high", "low", F.explode(keys).alias("at")).select("high", "low", "at.number", "at.key")
    full = work.save(rows.groupBy("key").count().where(F.col("count") > tables.tile), "full-keys")
    joined = rows.join(full, "key", "left")
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tables.tile).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "high", "low"), parts).cast("int")
    dealt = joined.select("high", "low", "number", "key", parts.alias("parts"), part.alias("part"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return dealt.select("*", others).select(
        "high", "low", "number", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def _compare(tables: Tables, emit):
    """Compares the rows of each (key, i, j), which stand together."""
    first_table, shifts = tables.first_table(), [tables.width * i for i in range(64 // tables.width)]
    mask = np.uint64((1 << tables.width) - 1)

    def equal_blocks(xors: list[np.ndarray]) -> np.ndarray:
        bits, at = np.zeros(len(xors[0]), np.int64), 0
        for x in xors:
            for s in shifts:
                bits |= ((x >> np.uint64(s)) & mask == 0).astype(np.int64) << at
                at += 1
        return bits

    def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        low, high = (t.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        key, number, part, i, j = (t.column(c).to_numpy() for c in ("key", "number", "part", "i", "j"))
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        end = np.repeat(np.append(new[1:], len(key)), np.diff(np.append(new, len(key))))
        left, step = np.arange(len(key)), 1
        while len(left := left[left + step < end[left]]):
            right = left + step
            apart = np.bitwise_count(low[left] ^ low[right]) + np.bitwise_count(high[left] ^ high[right])
            use = np.flatnonzero((apart <= tables.radius) & ((i[left] == j[left]) | (part[left] != part[right])))
            if len(use):
                a, b = left[use], right[use]
                here = first_table[equal_blocks([low[a] ^ low[b], high[a] ^ high[b]])] == number[a]
                yield a[here], b[here], apart[use][here].astype(np.int64)
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            place = [waiting.column(c).to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([p != p[-1] for p in place])) if len(waiting) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from emit(waiting.slice(0, cut).combine_chunks(), pairs)
                waiting = waiting.slice(cut).combine_chunks()
        if waiting is not None and len(waiting):
            yield from emit(waiting.combine_chunks(), pairs)

    return run


def _emit_counts(t: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(t), np.int64)
    for a, b, _ in pairs(t):
        counts += np.bincount(a, minlength=len(t)) + np.bincount(b, minlength=len(t))
    use = pa.array(counts > 0)
    out = t.select(["high", "low"]).append_column("n", pa.array(counts)).filter(use)
    yield from out.to_batches()


def _emit_links(t: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
    for a, b, apart in pairs(t):
        sides = [t.column(c).to_numpy()[at] for at in (a, b) for c in ("high", "low")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, sides), pa.array(apart)],
                                         names=["a_high", "a_low", "b_high", "b_low", "distance"])


def _together(posted: DataFrame) -> DataFrame:
    return posted.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "high", "low")


def near_links(found: DataFrame, tables: Tables = Tables()) -> DataFrame:
    """A row (a_high, a_low, b_high, b_low, distance) for each pair of different fingerprints within the radius.

    `found` has the columns high and low, the halves of distinct fingerprints without nulls; other columns are not
    read. No pair is lost and none comes twice. An empty table gives no pairs.
    """
    schema = "a_high bigint, a_low bigint, b_high bigint, b_low bigint, distance bigint"
    return _together(_posted(found, tables)).mapInArrow(_compare(tables, _emit_links), schema)


def near_counts(found: DataFrame, tables: Tables = Tables()) -> DataFrame:
    """(high, low, n_near) of the fingerprints that have others within the radius, and how many. As `near_links`.

    Tasks hand over counts, not pairs: large groups of near fingerprints cost comparisons, but no rows for each pair.
    """
    some = _together(_posted(found, tables)).mapInArrow(_compare(tables, _emit_counts), "high bigint, low bigint, n bigint")
    return some.groupBy("high", "low").agg(F.sum("n").alias("n_near"))


EDITS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _edited(texts: pa.Array) -> dict[str, pa.Array]:
    found = texts.to_pylist()
    edited = [a[:len(a) - len(a) // 3] + b[:len(a) // 3] for a, b in zip(found, found[1:])]
    prints = as_hex(fingerprints(texts))
    return {
        "n_chars": pa.array([len(a) for a in found[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": prints.slice(0, len(edited)), "next_fingerprint": prints.slice(1),
        "edited_fingerprint": as_hex(fingerprints(pa.array(edited, pa.string()))),
    }


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) for each row of `docs`.

    An edited text has the last third of its code points (rounded down) replaced by as many from the start of the next
    text, or all of it if it is shorter. What the next row is, also for null, equal and single ids, `each_with_next`
    says. Null and empty texts have no code points and the fingerprint of no terms. An empty table gives no rows; of
    the columns only id and text are read; texts are taken whole.
    """
    return each_with_next(docs, _edited, EDITS, id_col, text_col)


def with_near(docs: DataFrame, tables: Tables = Tables(), column: str = "fingerprint") -> DataFrame:
    """Every row with n_same, the rows of its fingerprint, itself included, and n_near, the others within the radius.

    `column` holds fingerprints as 32 hexadecimal digits; a null has nulls. Different fingerprints count once each,
    however many rows have them. Columns of these two names are replaced; others stay. An empty table stays empty.
    """
    spark, p = docs.sparkSession, work.free_prefix(docs)
    docs = docs.drop("n_same", "n_near")
    high, low = halves(F.col("digits"))
    distinct = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("digits")).agg(F.count("*").alias("n_same"))
    found = work.save(distinct.select("digits", "n_same", high.alias("high"), low.alias("low")), "fingerprints")
    counts = found.join(near_counts(found, tables), ["high", "low"], "left")
    schema = "digits string, n_same bigint, n_near bigint"
    # Written before the join, so that Spark sees how large it is and splits the rows of a frequent fingerprint.
    more = work.load(spark, work.write(counts.where("n_same > 1 OR n_near > 0").select(
        "digits", "n_same", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")), "near"), schema)
    more = more.select(F.col("digits").alias(p), F.col("n_same").alias(f"{p}same"), F.col("n_near").alias(f"{p}near"))
    known = F.col(column).isNotNull()
    return docs.join(more, docs[column] == more[p], "left").select(
        *[docs[c] for c in docs.columns], F.when(known, F.coalesce(f"{p}same", F.lit(1))).cast("bigint").alias("n_same"),
        F.when(known, F.coalesce(f"{p}near", F.lit(0))).cast("bigint").alias("n_near"))
