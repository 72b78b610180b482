import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmap.llm import queries
from corpusmap.llm.runs import Positions, Rule, find_runs, periodic_runs, suffix_neighbours
from tests.llm.common import awkward, frame, prose, words


def brute(w, rule=Rule()):
    """Maximal stretches for each period, kept where no smaller period holds the whole stretch."""
    found, n = [], len(w)
    for q in range(1, n // rule.times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(rule.min_words, rule.times * q):
                if not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def codes(w):
    number = {}
    return np.array([number.setdefault(x, len(number)) for x in w], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.sampled_from([(2, 2), (6, 3), (5, 2), (1, 4), (24, 3)]))
def test_equals_brute_force_on_two_words(w, rule):
    assert find_runs(codes(w), Rule(*rule)) == brute(w, Rule(*rule))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000))
def test_equals_brute_force_on_planted_runs(seed):
    rng = random.Random(seed)
    w = []
    while len(w) < 150:
        unit = [rng.choice("abcde") for _ in range(rng.randint(1, 12))]
        w += (unit * rng.randint(1, 6))[:rng.randint(1, 60)]
    assert find_runs(codes(w)) == brute(w)


def test_common_prefixes():
    w = codes("x a b a b a y a b a".split())
    a, b, lcp = suffix_neighbours(w)
    for x, y, n in zip(a.tolist(), b.tolist(), lcp.tolist()):
        same = 0
        while max(x, y) + same < len(w) and w[x + same] == w[y + same]:
            same += 1
        assert same == n
    assert sorted([*a.tolist(), b.tolist()[-1]]) == list(range(len(w)))


def test_positions_stay_in_order():
    rng = random.Random(5)
    numbers = rng.sample(range(100_000), 5_000)
    held, seen = Positions(numbers[0]), {numbers[0]}
    for p in numbers[1:]:
        before, after = held.add(p)
        if len(seen) < 300:
            assert before == max((x for x in seen if x < p), default=None)
            assert after == min((x for x in seen if x > p), default=None)
        seen.add(p)
    assert list(held) == sorted(numbers) and held.size == 5_000


def test_long_texts():
    one = np.zeros(100_000, np.int64)
    assert find_runs(one) == [(0, 100_000, 1)]
    block = np.arange(20_000)
    assert find_runs(np.concatenate([[-1], *[block] * 4, [5, 6]])) == [(1, 80_000, 20_000)]


def test_a_run_needs_two_periods():
    with pytest.raises(ValueError):
        Rule(times=1)


def test_table(spark):
    rows = [*awkward(), (70, "x " + "a b c " * 9 + "a z"), (71, " ".join(["w"] * 24)), (72, " ".join(["w"] * 23)),
            (73, "say " * 30 + "it " * 25), (74, "one\ttwo\n" * 12)]
    docs = frame(spark, rows, extra=True)
    done = periodic_runs(docs)
    assert done.columns == [*docs.columns, "periodic"] and periodic_runs(docs.where("false")).count() == 0
    assert periodic_runs(done).columns == done.columns
    out = done.select("doc_id", "text", "periodic.*", F.col("periodic.text").alias("kept")).collect()
    assert len(out) == len(rows)
    for r in out:
        w = words(r[1])
        runs = [tuple(x) for x in r["runs"]]
        assert r["n_words"] == len(w)
        if len(w) < 2_000:
            assert runs == brute(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["kept"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    by = {r["doc_id"]: r for r in out}
    assert [tuple(x) for x in by[70]["runs"]] == [(1, 28, 3)] and by[70]["kept"] == "x a b c z"
    assert [tuple(x) for x in by[73]["runs"]] == [(0, 30, 1), (30, 25, 1)] and by[73]["kept"] == "say it"
    assert by[72]["runs"] == [] and by[71]["kept"] == "w" and by[20]["n_words"] == 0


def expected(doc_id, text):
    """The contract's row, word by word."""
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w) if n < 400 else find_runs(codes(w))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in awkward() if i is not None]
    rows += [(100 + i, prose(1 + 3 * i, i)) for i in range(120)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns[:8] == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
