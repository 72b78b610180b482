"""A hidden Markov language model: Baum-Welch over all training texts, exact scores by the scaled forward recursion.

States emit word classes and a class emits its words by their counts, so the model's size does not grow with the
vocabulary. A word that makes up `frequent` or more of the training tokens has a class by its own hash, any other one
by the hash of its ending. The end of a text is a class; a word never seen in training has the same small probability
in every state as under the unigram base.

Texts are turned into blocks of word numbers once. Word counts of the whole corpus are summed in shards of the key
space and sent back to the blocks. Each Baum-Welch round is one job: tasks run the forward and backward recursions
over whole texts, side by side, and their expected counts are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.blocks import BLOCK_BYTES, block_numbers, from_bytes, table_from_bytes, table_to_bytes, to_bytes
from corpusmap.llm.texts import one_array, slices, words

OWN_CLASSES, ENDING_CLASSES = 1 << 14, 1 << 12
END = OWN_CLASSES + ENDING_CLASSES  # the class of the end of a text
UNKNOWN = END + 1
N_CLASSES = END + 1
ADD = 0.1
SEED = np.dtype([("class", "<u2"), ("n", "<u4")])
WORD = np.dtype([("h", "<u8"), ("n", "<u4"), ("ending", "<u2")])
BLOCK = "block bigint, n_words bigint, n_train bigint, n_train_docs bigint, docs binary, codes binary, words binary"
MESSAGE = "part int, block bigint, data binary"
CODED = "block bigint, docs binary, codes binary, counts binary, classes binary"
SLICES = 8


@dataclass(frozen=True)
class Options:
    states: int = 8
    rounds: int = 4
    frequent: float = 1e-5
    stay: float = 0.9  # first probability of staying in a state
    seed_docs: int = 400  # texts among which the states' first emissions are chosen; training covers all texts
    seed_words: int = 20  # least words of such a text
    shard_words: int = 1_000_000


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states): of a class, given the state
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_tokens: int
    n_distinct: int
    n_ends: int

    @property
    def unknown(self) -> float:
        return ADD / (self.n_tokens + ADD * (self.n_distinct + 1))

    def table(self) -> np.ndarray:
        """Emissions of all classes and, last, of an unknown word."""
        known = self.emit * (1 - self.unknown)
        if not self.n_ends:
            known[END] = self.unknown
        return np.vstack([known, np.full((1, len(self.start)), self.unknown)])


# Blocks ---------------------------------------------------------------------------------------------------------


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = block_numbers()
    for batch in batches:
        texts = one_array(batch.column(1))
        for a, b in slices(texts, BLOCK_BYTES):
            train = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
            flat, counts = words(texts.slice(a, b - a), lower=True)
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            found = np.zeros(len(distinct), WORD)
            found["h"] = [xxhash.xxh3_64_intdigest(w) for w in distinct]
            found["ending"] = [xxhash.xxh3_64_intdigest(w.rstrip(b".,;:!?")[-4:]) & 0xFFFF for w in distinct]
            found["n"] = np.bincount(codes[np.repeat(train, counts)], minlength=len(distinct))
            order = np.argsort(found["h"], kind="stable")
            place = np.zeros(len(distinct), np.uint32)
            place[order] = np.arange(len(distinct), dtype=np.uint32)
            docs = pa.table({"id": batch.column(0).slice(a, b - a), "n": pa.array(counts, pa.int64()), "train": train})
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([next(numbers)], pa.int64()), "n_words": pa.array([len(distinct)], pa.int64()),
                "n_train": pa.array([int(counts[train].sum() + train.sum())], pa.int64()),
                "n_train_docs": pa.array([int(train.sum())], pa.int64()),
                "docs": pa.array([table_to_bytes(docs)], pa.binary()),
                "codes": pa.array([to_bytes(place[codes])], pa.binary()),
                "words": pa.array([to_bytes(found[order])], pa.binary()),
            })


def _part_edges(h: np.ndarray, bits: int) -> np.ndarray:
    part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return np.searchsorted(part, np.arange((1 << bits) + 1))


def _send_words(bits: int):
    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words")):
                found = from_bytes(data.as_py(), WORD)
                edges = _part_edges(found["h"], bits)
                parts = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(parts), pa.int64()),
                    "data": pa.array([to_bytes(found[edges[p]:edges[p + 1]]) for p in parts], pa.binary()),
                })

    return send


def _classes(h: np.ndarray, ending: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    own = (h & np.uint64(OWN_CLASSES - 1)).astype(np.int64)
    known = np.where(n >= least, own, OWN_CLASSES + (ending.astype(np.int64) & (ENDING_CLASSES - 1)))
    return np.where(n > 0, known, UNKNOWN)


def _count_words(least: float):
    """Answers each block the corpus counts of its words; a row of block -1 holds (class, tokens, distinct words)."""

    def count(messages: pa.Table) -> pa.Table:
        parts = [from_bytes(d.as_py(), WORD) for d in messages.column("data")]
        sizes = [len(p) for p in parts]
        found = np.concatenate(parts)
        _, first, group = np.unique(found["h"], return_index=True, return_inverse=True)
        n = np.bincount(group, weights=found["n"]).astype(np.int64)
        classes = _classes(found["h"][first], found["ending"][first], n, least)
        known = classes < UNKNOWN
        used, at = np.unique(classes[known], return_inverse=True)
        totals = np.column_stack([
            used, np.bincount(at, weights=n[known], minlength=len(used)), np.bincount(at, minlength=len(used)),
        ]).astype(np.int64).reshape(-1)
        answers = [to_bytes(x) for x in np.split(n[group], np.cumsum(sizes)[:-1])]
        part = messages.column("part").to_pylist()
        return pa.table({
            "part": pa.array([*part, part[0]], pa.int32()),
            "block": pa.array([*messages.column("block").to_pylist(), -1], pa.int64()),
            "data": pa.array([*answers, to_bytes(totals) if len(totals) else None], pa.binary()),
        })

    return count


def _class_totals(answers: DataFrame) -> DataFrame:
    """A row (class, tokens, words) per class, summed over the shards, so that its size does not grow with the corpus."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                found = from_bytes(data.as_py(), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array(found[:, i], pa.int64()) for i, n in enumerate(("class", "tokens", "words"))})

    rows = answers.where("block = -1 AND data IS NOT NULL").select("data").mapInArrow(
        run, "class bigint, tokens bigint, words bigint")
    return rows.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))


def _code(least: float):
    """Blocks with the corpus counts and classes of their words."""

    def code(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        by_part = sorted(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist()))
        counts = np.concatenate([np.zeros(0, np.int64), *[from_bytes(d, np.int64) for _, d in by_part]])
        for r in blocks.to_pylist():
            found = from_bytes(r["words"], WORD)
            classes = _classes(found["h"], found["ending"], counts, least).astype(np.uint16)
            rows.append({"block": r["block"], "docs": r["docs"], "codes": r["codes"], "counts": to_bytes(counts),
                         "classes": to_bytes(classes)})
        return pa.Table.from_pylist(rows, pa.schema([
            ("block", pa.int64()), *[(n, pa.binary()) for n in ("docs", "codes", "counts", "classes")]]))

    return code


class Texts:
    """A block's texts as class numbers, ordered by step and, within a step, from the longest text to the shortest."""

    def __init__(self, row: dict, train_only: bool = False):
        docs = table_from_bytes(row["docs"])
        n_words = docs.column("n").to_numpy()
        codes = from_bytes(row["codes"], np.uint32).astype(np.int64)
        self.counts, classes = from_bytes(row["counts"], np.int64), from_bytes(row["classes"], np.uint16)
        chosen = docs.column("train").to_numpy(zero_copy_only=False).astype(bool) if train_only \
            else np.ones(len(n_words), bool)
        self.docs = docs.filter(pa.array(chosen))
        begin = np.cumsum(n_words) - n_words
        self.order = np.argsort(-n_words[chosen], kind="stable")
        self.begin, self.length = begin[chosen][self.order], n_words[chosen][self.order] + 1
        self.codes, self.classes = codes, classes.astype(np.int64)
        steps = int(self.length[0]) if len(self.length) else 0
        #: At each step so many texts, the longest ones, have a token.
        self.active = np.searchsorted(-self.length, -np.arange(steps), side="left")

    def step(self, t: int) -> np.ndarray:
        """Classes of the texts' tokens number t; the text that ends here has the end as its token."""
        n = int(self.active[t])
        out = np.full(n, END, np.int64)
        inside = int(np.searchsorted(-self.length[:n], -(t + 1), side="left"))
        out[:inside] = self.classes[self.codes[self.begin[:inside] + t]]
        return out


# Baum-Welch -----------------------------------------------------------------------------------------------------


def expected_counts(texts: Texts, start: np.ndarray, move: np.ndarray, table: np.ndarray):
    """(starts, moves, emissions, log-likelihood) expected over whole texts."""
    k, steps = len(start), len(texts.active)
    starts, moves = np.zeros(k), np.zeros((k, k))
    if not steps:
        return starts, moves, np.zeros((N_CLASSES, k)), 0.0
    offsets = np.concatenate([[0], np.cumsum(texts.active)]).astype(np.int64)
    total = int(offsets[-1])
    alpha, scale = np.empty((total, k), np.float32), np.empty(total, np.float32)
    tokens = np.empty(total, np.int64)
    small, step_move = table.astype(np.float32), move.astype(np.float32)
    for t in range(steps):
        a, b = offsets[t], offsets[t + 1]
        tokens[a:b] = texts.step(t)
        before = np.broadcast_to(start.astype(np.float32), (b - a, k)) if t == 0 \
            else alpha[offsets[t - 1]:offsets[t - 1] + b - a] @ step_move
        now = before * small[tokens[a:b]]
        scale[a:b] = now.sum(axis=1)
        alpha[a:b] = now / scale[a:b, None]
    beta = np.ones((int(texts.active[-1]), k), np.float32)
    for t in range(steps - 1, 0, -1):
        a, b = offsets[t], offsets[t + 1]
        ahead = small[tokens[a:b]] * beta / scale[a:b, None]
        alpha[a:b] *= beta  # from here on the probability of the state
        p = offsets[t - 1]
        moves += alpha[p:p + b - a].T.astype(np.float64) @ ahead
        beta = np.ones((int(texts.active[t - 1]), k), np.float32)
        beta[:b - a] = ahead @ step_move.T
    alpha[:offsets[1]] *= beta
    starts += alpha[:offsets[1]].sum(axis=0)
    emissions = np.column_stack([np.bincount(tokens, weights=alpha[:, s], minlength=UNKNOWN + 1)[:N_CLASSES]
                                 for s in range(k)])
    return starts, moves * move, emissions, float(np.log(scale.astype(np.float64)).sum())


def _expect(model: Model):
    start, move, table = model.start, model.move, model.table()
    k = len(start)

    def run(batches):
        total = np.zeros(k + k * k + N_CLASSES * k + 1)
        for batch in batches:
            for row in batch.to_pylist():
                starts, moves, emissions, likelihood = expected_counts(Texts(row, True), start, move, table)
                total += np.concatenate([starts, moves.ravel(), emissions.ravel(), [likelihood]])
        parts = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(range(SLICES), pa.int32()), "data": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(d.as_py(), np.float64) for d in table.column("data"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _round(coded: DataFrame, model: Model) -> tuple[Model, float]:
    k = len(model.start)
    partial = coded.mapInArrow(_expect(model), "slice int, data binary")
    # Two steps, so that the sums of many tasks meet in many tasks first.
    some = partial.groupBy("slice", F.spark_partition_id() % 32).applyInArrow(_add, "slice int, data binary")
    rows = some.groupBy("slice").applyInArrow(_add, "slice int, data binary").collect()
    flat = np.concatenate([np.frombuffer(r["data"], np.float64) for r in sorted(rows, key=lambda r: r["slice"])])
    return _maximize(flat[:k], flat[k:k + k * k].reshape(k, k), flat[k + k * k:-1].reshape(N_CLASSES, k), model), flat[-1]


def _shares(model: Model) -> np.ndarray:
    tokens = np.append(model.class_tokens, model.n_ends).astype(float)
    return tokens / max(tokens.sum(), 1)


def _maximize(starts, moves, emissions, model: Model) -> Model:
    """Probabilities from expected counts, with a little of the whole corpus in each state."""
    emit = emissions + 100.0 * _shares(model)[:, None]
    model.start = (starts + 1) / (starts + 1).sum()
    model.move = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
    model.emit = emit / np.maximum(emit.sum(axis=0, keepdims=True), 1e-300)
    return model


def _first_model(coded: DataFrame, model: Model, options: Options) -> Model:
    """States begin as the corpus mixed with texts that differ most from each other."""

    share = min(1.0, (2 * options.seed_docs + 100) / max(model.n_ends, 1))

    def sample(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row, True)
                ids = [xxhash.xxh3_64_intdigest(str(i)) >> 1 for i in texts.docs.column("id").to_pylist()]
                ids = np.array(ids, np.int64)[texts.order]
                # A share of all texts by hash, so that what tasks hand over does not grow with their number.
                few = np.flatnonzero(ids <= share * float(1 << 63))
                for d in few[np.argsort(ids[few], kind="stable")][:options.seed_docs].tolist():
                    a, n = int(texts.begin[d]), int(texts.length[d]) - 1
                    if n >= options.seed_words:
                        counts = np.bincount(texts.classes[texts.codes[a:a + n]])
                        found = np.zeros(np.count_nonzero(counts), SEED)
                        found["class"] = np.flatnonzero(counts)
                        found["n"] = counts[found["class"]]
                        yield pa.RecordBatch.from_pydict({"key": pa.array([ids[d]], pa.int64()),
                                                          "counts": pa.array([to_bytes(found)], pa.binary())})

    rows = coded.mapInArrow(sample, "key bigint, counts binary").orderBy("key", "counts").limit(options.seed_docs)
    shares, k = _shares(model), options.states
    seeds = [from_bytes(r["counts"], SEED) for r in rows.collect()]
    found = [np.bincount(s["class"], s["n"], N_CLASSES)[:N_CLASSES] for s in seeds]
    points = [np.sqrt(f / f.sum()) for f in found if f.sum()]
    chosen: list[np.ndarray] = []
    if points:
        grid = np.array(points)
        nearest = grid @ np.sqrt(shares)
        for _ in range(k):
            chosen.append(grid[int(np.argmin(nearest))] ** 2)
            nearest = np.maximum(nearest, grid @ np.sqrt(chosen[-1]))
    emit = np.column_stack([0.7 * shares + 0.3 * chosen[s] if s < len(chosen) else shares for s in range(k)])
    model.start = np.full(k, 1 / k)
    model.move = np.full((k, k), (1 - options.stay) / max(k - 1, 1)) + np.eye(k) * (options.stay - (1 - options.stay) / max(k - 1, 1))
    if k == 1:
        model.move = np.ones((1, 1))
    model.emit = emit
    return model


# Scores ---------------------------------------------------------------------------------------------------------


def forward(texts: Texts, start: np.ndarray, move: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text's classes, in the order of `texts.order`."""
    out = np.zeros(len(texts.length))
    alpha = None
    for t, n in enumerate(texts.active.tolist()):
        before = np.broadcast_to(start, (n, len(start))) if t == 0 else alpha[:n] @ move
        now = before * table[texts.step(t)]
        scale = now.sum(axis=1)
        alpha = now / scale[:, None]
        out[:n] += np.log10(scale)
    return out


def _score(model: Model):
    start, move, table = model.start, model.move, model.table()
    class_tokens, class_words = model.class_tokens, model.class_words
    n_tokens, n_distinct, n_ends = model.n_tokens, model.n_distinct, model.n_ends

    def run(batches):
        base_of = lambda c: np.log10((c + ADD) / (n_tokens + ADD * (n_distinct + 1)))
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row)
                n_words = texts.docs.column("n").to_numpy()
                known = texts.counts > 0
                inside = np.where(known, texts.classes, 0)
                share = (texts.counts + ADD) / np.maximum(class_tokens[inside] + ADD * class_words[inside], ADD)
                within = np.where(known, np.log10(share), 0.0)
                ends = np.cumsum(n_words)

                def total(values):
                    sums = np.concatenate([[0], np.cumsum(values[texts.codes])])
                    return sums[ends] - sums[ends - n_words]

                score = np.zeros(len(n_words))
                if n_tokens:  # else there is nothing that a state could know: every token has probability 1
                    score[texts.order] = forward(texts, start, move, table)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(texts.docs.column("id").combine_chunks()),
                    "train": pa.array(texts.docs.column("train").combine_chunks()),
                    "n_tokens": pa.array(n_words + 1, pa.int64()),
                    "n_known": pa.array(total(known.astype(np.int64)) + (n_ends > 0), pa.int64()),
                    "train_tokens": pa.array(np.full(len(n_words), n_tokens), pa.int64()),
                    "base_score": pa.array(total(base_of(texts.counts)) + base_of(n_ends), pa.float64()),
                    "score": pa.array(score + total(within), pa.float64()),
                })

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                options: Options = Options()) -> DataFrame:
    """Train on the rows where `train` holds and score all rows with the model and with a unigram base.

    Returns (id, train, n_tokens, n_known, train_tokens, base_score, score). Tokens are the words of the text with A-Z
    lower-cased, and its end. A null or empty text is its end alone. A null in `train` counts as true. Equal rows score
    the same; repeated rows count as often as they come; without training rows every token is unknown and has
    probability 1; an empty table gives an empty table. Of the columns only id, text and those of `train` are read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col), F.coalesce(train, F.lit(True)))
    blocks = work.save(source.mapInArrow(_word_blocks, BLOCK), "word-blocks")
    n_words, n_train, n_ends = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_train"), F.sum("n_train_docs")).first())
    bits = max(1, math.ceil(math.log2(max(1, n_words / options.shard_words))))
    least = max(2.0, options.frequent * n_train)
    messages = blocks.select("block", "words").mapInArrow(_send_words(bits), MESSAGE)
    answers = work.save(messages.groupBy("part").applyInArrow(_count_words(least), MESSAGE), "word-counts")
    totals = np.zeros((END, 2), np.int64)
    for r in _class_totals(answers).collect():
        totals[r["class"]] = r["tokens"], r["words"]
    model = Model(None, None, None, np.append(totals[:, 0], 0)[:END], totals[:, 1], int(n_train),
                  int(totals[:, 1].sum()) + (n_ends > 0), int(n_ends))
    back = blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
    coded = work.save(back.applyInArrow(_code(least), CODED), "coded-blocks")
    model = _first_model(coded, model, options)
    if n_train:
        for _ in range(options.rounds):
            model, _likelihood = _round(coded, model)
    return coded.mapInArrow(
        _score(model), f"id {id_type}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double")
