"""Texts as runs of segments that tokenizers never join, and tables of the tokens of segments. Used inside tasks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmap.llm.csr import ragged

#: Blanks beside other white space, or at the ends of a text, may enter one token with it.
JOINED = r"  |^ | $|[\p{Z}\p{C}] [\p{Z}\p{C}]|[\p{Z}\p{C}] $"


def segments(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What stands between the blanks of each text, as a dictionary array, and how many of it each text has.

    A text whose blanks a token may join with other white space is one segment. An empty text has none.
    """
    whole = pc.match_substring_regex(texts, JOINED)
    empty = pc.equal(pc.binary_length(texts), 0)
    split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes[empty.to_numpy(zero_copy_only=False)] = 0
    flat = split.flatten()
    alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])[:-1]
    use = ragged(at, sizes)
    flat = flat.take(pa.array(use))
    if len(alone):
        mask = np.zeros(len(flat), bool)
        mask[(np.cumsum(sizes) - sizes)[alone]] = True
        flat = pc.replace_with_mask(flat, pa.array(mask), texts.take(pa.array(alone)))
    return flat.dictionary_encode(), sizes


class Lookup:
    """The ids of words by some encoders, kept from one call to the next until `limit` characters of words are held."""

    def __init__(self, encoders: list[Callable[[list[str]], list[list[int]]]], limit: int = 3 << 20):
        self.encoders, self.limit = encoders, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.ids = [np.zeros(0, np.uint32) for _ in self.encoders]
        self.sizes = [np.zeros(0, np.int32) for _ in self.encoders]

    def __call__(self, found: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By each encoder the ids of all words (distinct ones) in a row, and how many each has."""
        if self.held > self.limit:
            self._clear()
        new = [w for w in found if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.held += sum(map(len, new))
            for i, encode in enumerate(self.encoders):
                rows = encode(new)
                sizes = np.fromiter(map(len, rows), np.int32, len(rows))
                more = np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum()))
                self.ids[i] = np.concatenate([self.ids[i], more])
                self.sizes[i] = np.concatenate([self.sizes[i], sizes])
        at = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        out = []
        for ids, sizes in zip(self.ids, self.sizes):
            starts, n = np.cumsum(sizes, dtype=np.int64) - sizes, sizes[at].astype(np.int64)
            out.append((ids[ragged(starts[at], n)], n))
        return out
