import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import hmm
from corpusmap.llm.blocks import table_to_bytes, to_bytes
from tests.llm.common import awkward, frame, lower, prose, words


def block(sequences, train=None):
    """A coded block of class sequences."""
    flat = [c for s in sequences for c in s]
    classes = sorted(set(flat))
    docs = pa.table({"id": list(range(len(sequences))), "n": [len(s) for s in sequences],
                     "train": train or [True] * len(sequences)})
    return {"docs": table_to_bytes(docs), "codes": to_bytes(np.array([classes.index(c) for c in flat], np.uint32)),
            "counts": to_bytes(np.ones(len(classes), np.int64)), "classes": to_bytes(np.array(classes, np.uint16))}


def model(k=3, seed=0):
    rng = np.random.default_rng(seed)
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k)
    return start, move, rng.random((hmm.UNKNOWN + 1, k))


SEQUENCES = [[1, 2, 1], [], [5], [2, 2, 1, 5], [1], [5, 1, 2]]


def paths(sequence, start, move, table):
    tokens = [*sequence, hmm.END]
    for path in product(range(len(start)), repeat=len(tokens)):
        p = start[path[0]]
        for a, b in zip(path, path[1:]):
            p *= move[a, b]
        yield path, tokens, p * math.prod(table[t, s] for t, s in zip(tokens, path))


def test_forward_equals_the_sum_over_paths():
    start, move, table = model()
    texts = hmm.Texts(block(SEQUENCES))
    got = np.zeros(len(SEQUENCES))
    got[texts.order] = hmm.forward(texts, start, move, table)
    for s, g in zip(SEQUENCES, got):
        assert g == pytest.approx(math.log10(sum(p for _, _, p in paths(s, start, move, table))), rel=1e-9)


def test_expected_counts_equal_the_sum_over_paths():
    start, move, table = model()
    train = [True, True, False, True, True, True]
    starts, moves, emissions, likelihood = hmm.expected_counts(hmm.Texts(block(SEQUENCES, train), True), start, move, table)
    want_start, want_moves, want_emit, want_log = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.N_CLASSES, 3)), 0.0
    for s, t in zip(SEQUENCES, train):
        if t:
            found = list(paths(s, start, move, table))
            total = sum(p for _, _, p in found)
            want_log += math.log(total)
            for path, tokens, p in found:
                want_start[path[0]] += p / total
                for a, b in zip(path, path[1:]):
                    want_moves[a, b] += p / total
                for token, state in zip(tokens, path):
                    want_emit[token, state] += p / total
    assert np.allclose(starts, want_start, atol=1e-4) and np.allclose(moves, want_moves, atol=1e-4)
    assert np.allclose(emissions, want_emit, atol=1e-4) and likelihood == pytest.approx(want_log, rel=1e-5)


def corpus():
    # Two kinds of text with words of their own.
    rows = [(i, prose(60, i) if i % 2 else " ".join(w[::-1] + "q" for w in prose(60, i).split())) for i in range(300)]
    return rows + [(1000 + i if d is not None else None, t) for i, (d, t) in enumerate(awkward())]


def test_scores(spark):
    rows = corpus()
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = hmm.score_texts(frame(spark, rows, extra=True), train).collect()
    tokens = [[*words(lower(t)), None] for _, t in rows]
    learns = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    count = Counter(w for t, use in zip(tokens, learns) if use for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), use, len(t), sum(count[w] > 0 for w in t), n) for (d, _), t, use in zip(rows, tokens, learns))
    assert sorted((str(r["id"]), r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = {str(d): sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for (d, _), t in zip(rows, tokens)}
    held = [r for r in got if not r["train"]]
    for r in got:
        if r["id"] is not None:
            assert r["base_score"] == pytest.approx(base[str(r["id"])], rel=1e-9)
        assert math.isfinite(r["score"])
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_of_one_word_texts_sum_to_less_than_one(spark):
    """All texts of at most one word, the unknown word among them, are disjoint events."""
    rows = [(i, w) for i, w in enumerate(["a", "b", "c", "a", "a b", ""] * 5)]
    scored = hmm.score_texts(frame(spark, rows + [(99, "zzz")]), F.col("doc_id") < 90).collect()
    score = {t: r["score"] for r in scored for t in [dict(rows + [(99, "zzz")])[r["id"]]]}
    assert 0.3 < sum(10 ** score[t] for t in ("a", "b", "c", "", "zzz")) <= 1 + 1e-9


def test_class_totals_are_summed_before_they_are_collected(spark):
    shards = [[(1, 5, 2), (7, 1, 1)], [(1, 4, 1)], [(7, 2, 2), (9, 3, 1)], []]
    rows = [(p, -1, to_bytes(np.array(t, np.int64).reshape(-1)) if t else None) for p, t in enumerate(shards)]
    answers = spark.createDataFrame([*rows, (0, 3, b"an answer")], hmm.MESSAGE).repartition(3)
    assert sorted(map(tuple, hmm._class_totals(answers).collect())) == [(1, 9, 3), (7, 3, 3), (9, 3, 1)]


def test_first_emissions_come_from_whole_texts(spark, monkeypatch):
    first, models = hmm._first_model, []
    monkeypatch.setattr(hmm, "_first_model", lambda *given: models.append(first(*given)) or models[-1])
    hmm.score_texts(frame(spark, [(1, "a " * 2000 + "b " * 500)]), F.lit(True), options=hmm.Options(states=1, rounds=0))
    emit = models[0].emit[:, 0]
    want = [0.7 * 500 / 2501 + 0.3 * 0.2, 0.7 * 2000 / 2501 + 0.3 * 0.8]
    assert sorted(emit[emit > 0.01].tolist()) == pytest.approx(want)


def test_nothing_to_learn_from(spark):
    got = hmm.score_texts(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert hmm.score_texts(frame(spark, []), F.lit(True)).count() == 0
