"""Words, lines and windows of Arrow string arrays, as numpy arrays. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
U64 = np.uint64


def one_array(texts) -> pa.Array:
    """A plain string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.fill_null("")


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `max_bytes` bytes of text; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(a), int(b)


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) and how many each text has."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    return flat.filter(pa.array(full)), np.diff(ends[offsets])


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_keys(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit key for each word, the same in every task."""
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), dtype=U64, count=len(distinct))
    return keys[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, U64)


def windows(counts: np.ndarray, size: int) -> np.ndarray:
    """Where windows of `size` words that stay inside one text begin."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(total, dtype=np.int64)
    return at[at + size <= ends]


def window_keys(keys: np.ndarray, starts: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit key for each window, depending on its words and their order."""
    base = U64(0x9E3779B97F4A7C15 + 2 * seed)
    if not len(starts):
        return np.zeros(0, U64)
    n = len(keys) - size + 1
    out = keys[:n].copy()
    for j in range(1, size):
        out *= base
        out += keys[j:n + j]
    return mix(out[starts] + U64(seed))


def covered(total: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of `total` words lie in a window that begins at one of `starts`."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:total]) > 0


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of `values`, one run of `counts` at a time."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]
