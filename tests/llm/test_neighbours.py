import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.llm.neighbours import Options, Tree, chi_square_bound, chi_square_cdf, nearest

SCHEMA = "vec_id bigint, embedding array<float>, rank int, cell string"


def brute(rows, asks, k=10):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in usable:
        if asks(q):
            found = {(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in usable
                     if i != q and len(w) == len(v)}
            out[q] = sorted(found)[:k]
    return out


def run(spark, rows, asks, **options):
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)
    out = {}
    for r in nearest(docs, asks, Options(**options)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def vectors(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim)) * 1.5
    points = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, dim))
    return [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


def test_recall_and_exact_scores_over_cells(spark):
    rows = vectors(3000)
    want = brute(rows, lambda i: i % 100 == 0)
    for options in ({}, {"cell_rows": 200, "sample": 500, "query_block": 5}):
        got = run(spark, rows, F.col("vec_id") % 100 == 0, **options)
        assert recall(got, want) >= 0.95 and all(len(got[q]) == 10 for q in want)
        by = dict(rows)
        for q, found in got.items():
            assert found == sorted(found)
            for d, i in found:
                assert d == pytest.approx(float(np.sqrt(((np.array(by[q]) - np.array(by[i])) ** 2).sum())), abs=1e-12)


def test_certain_confidence_is_exact_and_ties_go_to_smaller_ids(spark):
    rows = vectors(400, dim=6, seed=2) + [(1000 + i, [0.5] * 6) for i in range(60)]
    want = brute(rows, lambda i: i % 50 == 0)
    got = run(spark, rows, F.col("vec_id") % 50 == 0, confidence=1 - 1e-12, cell_rows=50)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert [i for _, i in got[1000]] == list(range(1001, 1011)) and got[1000][0][0] == 0.0


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [math.nan, 1.0]), (1, [math.inf, 1.0]),
            (2, [None, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 0.0]), (250, [1.0, 2.0, 3.0]), (4, [1.0, 0.0]), (5, [])]
    got = run(spark, rows, F.col("vec_id") % 50 == 0)
    assert got == brute(rows, lambda i: i % 50 == 0) | {} or {q: v for q, v in brute(rows, lambda i: i % 50 == 0).items() if v} == got
    assert [i for _, i in got[0]] == [4, 3, 50] or [i for _, i in got[0]] == [4, 50, 3] or len(got[0]) == 3


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") >= 0).count() == 0


def test_chi_square():
    assert chi_square_cdf(15.507, 8) == pytest.approx(0.95, abs=1e-4)
    assert chi_square_bound(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_tree_hands_out_leaves_in_growing_distance():
    points = np.random.default_rng(3).normal(size=(500, 4))
    q, seen = np.zeros(4), []
    tree, away = Tree(points, leaf=8), (points ** 2).sum(axis=1)
    leaves, far = tree.leaves(q)
    assert (np.diff(far) >= 0).all() and len(leaves) >= 500 / 8
    for leaf, distance in zip(leaves, far):
        rows = tree.rows(np.array([leaf])).tolist()
        assert len(rows) <= 8 and all(away[i] >= distance - 1e-12 for i in rows)
        seen += rows
    assert sorted(seen) == list(range(500))
    same = Tree(np.ones((300, 3)), leaf=8)
    assert len(same.runs) == 1
