"""Quality rules: compression bands.

A text is compressed by zstandard as a whole and in fixed chunks. Repetitive text shrinks too well, random
characters do not shrink; how much prose shrinks depends on its length, so each length band has limits of its own.
Word rules come first: too few words, or too many words in repeated five-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.texts import covered, mix, one_array, per_text, slices, window_keys, windows, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
FIELDS = (
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"),
    ("odd_chunks", "double"),
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio of plain to compressed bytes.

    `limits` holds (texts shorter than so many bytes, least ratio, greatest ratio). Zstandard's frame and tables cost
    some 20 to 100 bytes, so short prose hardly shrinks, while long prose shrinks to a third or less. The least ratios
    lie between random characters of the base64 alphabet and prose of the same length; below 112 bytes both come out
    alike, so random characters are kept there. Random hexadecimal digits shrink like prose.
    A text falls if its whole ratio is outside its band, or if more than `chunk_share` of its chunks of `chunk_bytes`
    are outside theirs, by the same limits. A last chunk below half the size joins the one before, so a text has chunks
    from 1.5 times the size on; a shorter one is its only chunk.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (112, 0.4, 2.5), (128, 1.01, 2.5), (160, 1.075, 2.75), (192, 1.1, 2.75), (224, 1.13, 2.75), (256, 1.17, 2.75),
        (320, 1.22, 2.75), (384, 1.26, 2.75), (512, 1.3, 2.75), (640, 1.34, 3.0), (768, 1.37, 3.0),
        (1024, 1.43, 3.0), (2048, 1.5, 3.0), (8192, 1.6, 3.5), (float("inf"), 1.6, 4.25),
    )
    chunk_bytes: int = 1024
    chunk_share: float = 0.2
    level: int = 3
    min_words: int = 10
    repeat_percent: int = 20


def _dup_lines(texts: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    text_of = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pc.list_parent_indices(lists)
    text_of = np.asarray(text_of).astype(np.int64)
    full = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy(zero_copy_only=False) > 0
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(flat) + 1
    pairs = np.unique((text_of * n + code)[full])
    return np.bincount(text_of[full], minlength=len(texts)) - np.bincount(pairs // n, minlength=len(texts))


def _repeated(flat: pa.Array, counts: np.ndarray) -> np.ndarray:
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = windows(counts, WINDOW)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    text_of = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)[starts]
    # In the same slice equal words have equal codes; the text's number keeps texts apart.
    keys = mix(window_keys(mix(code.astype(np.uint64) + np.uint64(1)), starts, WINDOW) ^ mix(text_of + np.uint64(7)))
    _, group, times = np.unique(keys, return_inverse=True, return_counts=True)
    return per_text(covered(len(flat), starts[times[group] >= 2], WINDOW), counts)


def _inside(limits: tuple, sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Which ratios lie in the band of their length."""
    edges, low, high = np.array(limits).T
    band = np.searchsorted(edges, sizes, side="right").clip(max=len(edges) - 1)
    return (ratios >= low[band]) & (ratios <= high[band])


def _ratios(data: bytes, bands: Bands, zstd) -> tuple[float, float]:
    if not data:
        return 1.0, 0.0
    ratio = len(data) / len(zstd.compress(data))
    cuts = list(range(0, len(data), bands.chunk_bytes))
    if len(data) - cuts[-1] < bands.chunk_bytes // 2:
        cuts.pop()
    if len(cuts) < 2:
        return ratio, 0.0
    ends = [*cuts[1:], len(data)]
    sizes = np.subtract(ends, cuts)
    chunks = sizes / [len(zstd.compress(data[a:b])) for a, b in zip(cuts, ends)]
    return ratio, float((~_inside(bands.limits, sizes, chunks)).mean())


def _judge(texts: pa.Array, bands: Bands, zstd) -> dict[str, np.ndarray]:
    flat, counts = words(texts)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    out = {
        "n_words": counts.astype(np.int64),
        "word_chars": per_text(pc.utf8_length(flat).to_numpy(zero_copy_only=False), counts),
        "n_symbols": per_text(table[data], sizes),
        "n_dup_lines": _dup_lines(texts).astype(np.int64),
        "n_repeat_words": _repeated(flat, counts),
    }
    failed = (counts < bands.min_words) | (100 * out["n_repeat_words"] > bands.repeat_percent * counts)
    ratios = np.array([_ratios(t, bands, zstd) for t in texts.cast(pa.binary()).to_pylist()]).reshape(-1, 2)
    good = _inside(bands.limits, sizes, ratios[:, 0]) & (ratios[:, 1] <= bands.chunk_share)
    return out | {"base_failed": failed, "kept": ~failed & good, "ratio": ratios[:, 0], "odd_chunks": ratios[:, 1]}


def quality(text: Column | str, bands: Bands = Bands()) -> Column:
    """What the rules find in a text, as a struct; null counts as an empty text, which fails."""

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS) + ">")
    def judged(texts: pa.Array) -> pa.Array:
        texts, zstd = one_array(texts), zstandard.ZstdCompressor(level=bands.level)
        parts = [_judge(texts.slice(a, b - a), bands, zstd) for a, b in slices(texts)]
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], kinds[t]) for n, t in FIELDS],
            names=[n for n, _ in FIELDS],
        )

    return judged(text)


def quality_rules(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text", into: str = "quality") -> DataFrame:
    """Every row with the struct of `quality` in the column `into`, which replaces one of that name.

    Rows are judged one by one: equal rows get equal verdicts, an empty table stays empty, other columns stay as they
    are, and a null or empty text has no words and fails. Whole texts are read, of any length.
    """
    return docs.withColumn(into, quality(F.col(text_col), bands))


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows whose texts pass, with the columns they came with."""
    return docs.where(quality(F.col(text_col), bands)["kept"])
