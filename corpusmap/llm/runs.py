"""Periodic runs of words: stretches that repeat with some period, found by a Kruskal pass over suffix classes.

The suffixes of a text stand in trie order; neighbours are joined by edges whose weight is the length of their common
prefix (LCP). Taken by decreasing LCP, edges unite classes of suffixes that share at least so many words. A class keeps
its positions in order, the smaller class moves into the larger one. Two positions that come to stand side by side, at
a distance within the LCP, seed a run: the earlier one starts it unless the word before keeps the period, and the
distance is the smallest period, as a smaller one would have put a position of the class in between.

Only suffixes that share `floor` words with another suffix of their text can seed a run that is long enough. A hash of
all windows of that length finds the texts that hold such suffixes; other texts cost that one pass. Hash collisions
only let texts through that have no run.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.texts import mix, one_array, slices, window_keys, windows, words

RUN = "struct<start:bigint,length:bigint,period:bigint>"
RUNS = f"struct<n_words:bigint,runs:array<{RUN}>,text:string>"


@dataclass(frozen=True)
class Rule:
    """A run has at least `min_words` words and `times` periods (2 or more)."""

    min_words: int = 24
    times: int = 3

    def __post_init__(self):
        if self.times < 2:
            raise ValueError("a run has at least two periods")

    @property
    def floor(self) -> int:
        """The least LCP that can seed a run: of all periods, the smallest of the run's length without one period."""
        return min(max(self.min_words - q, (self.times - 1) * q) for q in range(1, max(self.min_words, 1) + 1))


class Positions:
    """Positions in order, in pieces of bounded length, so that adding one costs little in any number of them."""

    WIDTH = 512

    def __init__(self, position: int):
        self.pieces, self.firsts, self.size = [[position]], [position], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Takes a position in; gives the one before it and the one after it."""
        i = max(bisect_right(self.firsts, position) - 1, 0)
        piece = self.pieces[i]
        j = bisect_left(piece, position)
        before = piece[j - 1] if j else None
        if j < len(piece):
            after = piece[j]
        else:
            after = self.firsts[i + 1] if i + 1 < len(self.firsts) else None
        piece.insert(j, position)
        self.firsts[i] = piece[0]
        self.size += 1
        if len(piece) > 2 * self.WIDTH:
            self.pieces[i:i + 1] = [piece[:self.WIDTH], piece[self.WIDTH:]]
            self.firsts.insert(i + 1, piece[self.WIDTH])
        return before, after


def suffix_neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of all suffixes of a text, and the length of their common prefix."""
    n = len(codes)
    ranks, step = [np.unique(codes, return_inverse=True)[1].astype(np.int32)], 1
    while ranks[-1].max() < n - 1:  # ranks by the first 1, 2, 4, ... words until all differ
        last = ranks[-1].astype(np.int64)
        pairs = last * (n + 1)
        pairs[:max(n - step, 0)] += last[step:] + 1
        ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for level in reversed(range(len(ranks))):
        rank = np.append(ranks[level], -1)
        lcp += (rank[a + lcp] == rank[b + lcp]).astype(np.int64) << level
    return a, b, lcp


def find_runs(codes: np.ndarray, rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, given as a number for each word; by start, then period."""
    if len(codes) < 2:
        return []
    a, b, lcp = suffix_neighbours(codes)
    chosen = np.flatnonzero(lcp >= max(rule.floor, 1))
    chosen = chosen[np.argsort(-lcp[chosen], kind="stable")]
    home = dict.fromkeys(np.concatenate([a[chosen], b[chosen]]).tolist())
    for position in home:
        home[position] = Positions(position)
    word, more, found = codes.tolist(), rule.times - 1, []

    def seed(x: int, y: int, shared: int) -> None:
        period = y - x
        if more * period <= shared and period + shared >= rule.min_words and (not x or word[x - 1] != word[y - 1]):
            found.append((x, period + shared, period))

    for x, y, shared in zip(a[chosen].tolist(), b[chosen].tolist(), lcp[chosen].tolist()):
        large, small = home[x], home[y]
        if large.size < small.size:
            large, small = small, large
        moved = list(small)
        previous = None
        for i, position in enumerate(moved):
            home[position] = large
            before, after = large.add(position)
            # Pairs that the smaller class held before, or that its next position parts again, are not new neighbours.
            if before is not None and before != previous:
                seed(before, position, shared)
            if after is not None and (i + 1 == len(moved) or moved[i + 1] > after):
                seed(position, after, shared)
            previous = position
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_with_repeats(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the texts in which some window of `size` words stands twice; perhaps a few others."""
    starts = windows(counts, size)
    row = np.repeat(np.arange(len(counts)), counts)[starts]
    keys = window_keys(mix(codes.astype(np.uint64) + np.uint64(1)), starts, size) + mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    return np.unique(row[order[1:][same]])


def _slice(texts: pa.Array, rule: Rule) -> pa.StructArray:
    flat, counts = words(texts)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    rows: list[tuple[int, int, int]] = []
    per_text, gone = np.zeros(len(counts), np.int64), np.zeros(len(flat) + 1, np.int64)
    for t in texts_with_repeats(codes, counts, max(rule.floor, 1)).tolist():
        begin = int(ends[t] - counts[t])
        found = find_runs(codes[begin:ends[t]], rule)
        rows += found
        per_text[t] = len(found)
        for start, length, period in found:
            gone[begin + start + period] += 1
            gone[begin + start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    kept = np.add.reduceat(np.append(keep, False), np.minimum(ends - counts, len(flat)), dtype=np.int64) * (counts > 0)
    kept_words = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), flat.filter(pa.array(keep)))
    columns = np.array(rows, np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), runs),
         pc.binary_join(kept_words, " ")], names=["n_words", "runs", "text"])


def runs(text: Column | str, rule: Rule = Rule()) -> Column:
    """(n_words, runs, text) of a text: its words, its runs by start and period, and its words without the repeats."""

    @F.arrow_udf(RUNS)
    def found(texts: pa.Array) -> pa.Array:
        texts = one_array(texts)
        parts = [_slice(texts.slice(a, b - a), rule) for a, b in slices(texts)]
        return pa.concat_arrays(parts) if parts else _slice(texts, rule)

    return found(text)


def periodic_runs(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text", into: str = "periodic") -> DataFrame:
    """Every row with (n_words, runs, text) in the column `into`, which replaces one of that name.

    A run (start, length, period) is a stretch of words with the smallest period `period`, of at least `min_words`
    words and `times` periods, that no neighbouring word extends; words are numbered from 0. `text` joins by single
    blanks the words that no run holds after its first `period` words. Words are runs of characters other than ASCII
    white space, compared as they are. A null, empty or blank text has no words and no runs; equal rows get equal runs,
    and runs of equal length are all reported; an empty table stays empty; other columns stay as they are. Texts are
    taken whole: a task needs some hundred bytes for each word of its longest text that holds repeated windows.
    """
    return docs.withColumn(into, runs(F.col(text_col), rule))


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first by start, then period; null if none."""
    # Products of two lengths of one text stay far below the bounds of a long.
    stronger = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]
    return F.aggregate(found, F.lit(None).cast(RUN), lambda s, r: F.when(s.isNull() | stronger(r, s), r).otherwise(s))


def as_text(found: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(found, line), "")
