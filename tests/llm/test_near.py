import random

import numpy as np
import pyarrow as pa
import pytest

from corpusmap.llm import near
from corpusmap.llm.graph import components
from corpusmap.llm.near import Options, near_duplicates
from tests.llm.common import awkward, frame, lower, prose, words


def shingles(text, size):
    found = words(lower(text))
    if len(found) >= size:
        return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)}
    return {tuple(found)} if found else set()


def brute(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    usable = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for x, i in enumerate(usable):
        for j in usable[:x]:
            both = len(sets[i] & sets[j])
            if find(i) != find(j) and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i in usable:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if i in set(usable) else d
        out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=str)


def run(spark, rows, **options):
    got = near_duplicates(frame(spark, rows).repartition(3), Options(**options)).collect()
    return sorted((tuple(r) for r in got), key=str)


def families(n, copies, edits, seed=3):
    rng, rows = random.Random(seed), []
    for f in range(n):
        base = prose(80, 9000 + seed * 50 + f).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = prose(1, rng.random())
            rows.append((len(rows) * 7 % 10_007, " ".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = awkward()
    assert run(spark, rows) == brute(rows)
    rows = families(12, 6, 6)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, size=5) == brute(rows, size=5)


def test_a_large_group_in_chunks_equals_brute_force(spark):
    rows = families(2, 90, 7, seed=4)
    assert run(spark, rows, chunk=16, leaders=3) == brute(rows)


def test_texts_that_share_a_passage_only_are_not_linked(spark):
    passage = prose(40, 1)
    rows = [(i, passage + " " + prose(60, 300 + i)) for i in range(80)] + [(200, passage), (201, passage + " end")]
    assert run(spark, rows) == brute(rows)


def test_chains_and_short_texts(spark):
    base = prose(60, 5).split()
    chain = [(100 - k, " ".join(prose(k, 6).split()[:k] + base[k:])) for k in range(0, 20, 2)]
    rows = chain + [(1, "a b c"), (2, "A B C"), (3, "a b"), (4, "a b c d"), (5, "a b c d")]
    assert run(spark, rows) == brute(rows)


def test_columns_and_empty(spark):
    assert near_duplicates(frame(spark, awkward(), extra=True)).count() == len(awkward())
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(1, None), (None, "a b c d e"), (2, " ")])).collect()
    assert sorted((str(r["id"]), r["kept"]) for r in got) == [("1", True), ("2", True), ("None", True)]


def test_pairs_with_few_equal_coordinates_are_linked(spark):
    """Pairs at similarity 0.8, 80 of 100 shingles, whose signatures agree in 37 and 36 coordinates only."""
    rows = []
    for pair in (33208, 80501):
        base = [f"{pair}x{i}" for i in range(93)]
        rows += [(pair, " ".join(base)), (pair + 1, " ".join(base[:83] + [f"{pair}y{i}" for i in range(10)]))]
    assert run(spark, rows) == brute(rows)


def test_parts_of_tokens_are_even():
    """Minima over 300 to 3000 shingles crowd near 0; each part still gets about `block_tokens` pairs."""
    rng, options = np.random.default_rng(2), Options(block_tokens=4096)
    multipliers = near._multipliers(options.coordinates)
    sigs = [near.signature(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), multipliers)
            for n in rng.integers(300, 3000, 2048)]
    tokens = near._tokens(pa.table({"sig": pa.array([x.tobytes() for x in sigs], pa.binary())}), options)
    flat = np.sort(tokens.ravel())
    sizes = np.diff(near._edges(flat, near._part_bits(len(flat), options), options))
    assert len(sizes) == 32 and sizes.sum() == len(flat)
    assert sizes.max() < 1.2 * options.block_tokens
    # Equal pairs, and only these, have equal numbers.
    plain = np.array(sigs).astype(np.int64) * options.coordinates + np.arange(options.coordinates)
    assert len(np.unique(np.column_stack([plain.ravel(), tokens.ravel().astype(np.int64)]), axis=0)) \
        == len(np.unique(plain)) == len(np.unique(flat))


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    ids = rng.permutation(300) * 11
    edges = {"path": list(zip(ids[:-1], ids[1:])), "star": [(ids[0], x) for x in ids],
             "random": [(ids[a], ids[b]) for a, b in rng.integers(0, 300, (200, 2))]}[shape]
    up = {int(i): int(i) for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(int(a)), find(int(b))
        up[max(x, y)] = min(x, y)
    touched = {int(x) for a, b in edges if a != b for x in (a, b)}
    table = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "x bigint, y bigint").repartition(5)
    for task_edges in (1_000_000, 20):  # all in one task, and in rounds
        got = components(table, task_edges).collect()
        assert {r["node"]: r["root"] for r in got} == {i: find(i) for i in touched} and len(got) == len(touched)
