import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import queries
from corpusmap.llm.simhash import (
    BITS, CHUNK, Tables, as_hex, distance, edits, fingerprint_words, fingerprints, likeness, near_counts, near_links,
    terms, with_fingerprint, with_near,
)
from tests.llm.common import awkward, frame, lower, prose, words


def number(text):
    return int(as_hex(fingerprints(pa.array([text or ""])))[0].as_py(), 16)


def votes(text):
    """The fingerprint bit by bit, from the terms."""
    from corpusmap.llm.texts import mix

    keys, weights, _ = terms(pa.array([text or ""]))
    out = 0
    for w in range(BITS // 64):
        hashes = mix(keys + np.uint64(w)).tolist()
        for bit in range(64):
            total = sum(int(n) if h >> bit & 1 else -int(n) for h, n in zip(hashes, weights.tolist()))
            out |= (total > 0) << (64 * w + bit)
    return out


def test_terms_are_words_and_pairs_by_count():
    _, weights, counts = terms(pa.array(["a b a b a", "", "x", "A a", "é"]))
    # a, b, (a b), (b a); then x; then a and (a a); then é
    assert counts.tolist() == [4, 0, 1, 2, 1] and sorted(weights[:4].tolist()) == [2, 2, 2, 2]
    assert len({*terms(pa.array(["a b"]))[0].tolist(), *terms(pa.array(["b a"]))[0].tolist()}) == 4


@pytest.mark.parametrize("n", [1, 2, 30, CHUNK // 2, 3 * CHUNK])
def test_votes(n):
    texts = [prose(n, seed) for seed in range(3)] + [None, "w " * n]
    got = as_hex(fingerprints(pa.array([t or "" for t in texts]))).to_pylist()
    assert [int(g, 16) for g in got] == [votes(t) for t in texts]


def test_a_text_has_the_same_fingerprint_in_any_company():
    texts = [t or "" for _, t in awkward()]
    together = as_hex(fingerprints(pa.array(texts))).to_pylist()
    assert together == [as_hex(fingerprint_words(pa.array([t])))[0].as_py() for t in texts]
    assert fingerprints(pa.array([], pa.string())).shape == (0, BITS // 64)


def test_likeness_follows_overlap():
    own, other = prose(300, 1), prose(300, 2)
    apart = lambda a, b: (number(a) ^ number(b)).bit_count()
    one = own.replace(own.split()[7], "changed", 1)
    assert apart(own, own) == 0 and apart(own, one) < 12 < apart(own, other)
    assert apart(own, " ".join(own.split()[:200] + other.split()[:100])) < apart(own, other)


def test_columns(spark):
    rows = awkward()
    docs = with_fingerprint(frame(spark, rows, extra=True))
    assert with_fingerprint(docs).columns == docs.columns and with_fingerprint(docs.where("false")).count() == 0
    out = docs.select("doc_id", "text", "fingerprint").collect()
    assert len(out) == len(rows) and all(int(r["fingerprint"], 16) == number(r["text"]) for r in out)
    pair = docs.where("doc_id = 3").select("fingerprint").crossJoin(docs.where("doc_id = 26").select(F.col("fingerprint").alias("g")))
    got = pair.select(distance(F.col("fingerprint"), F.col("g")), likeness(F.col("fingerprint"), F.col("g"))).first()
    apart = (number(rows[3][1]) ^ number([t for i, t in rows if i == 26][0])).bit_count()
    assert tuple(got) == (apart, 1 - apart / BITS)


def clustered(seed, n):
    """Random fingerprints, some a few bits from others, many of them from one."""
    rng = random.Random(seed)
    found = {rng.getrandbits(BITS) for _ in range(n)} | {0, (1 << BITS) - 1}
    base = sorted(found)
    for _ in range(2 * n):
        x = base[0] if rng.random() < 0.5 else rng.choice(base)
        for bit in rng.sample(range(BITS), rng.randint(0, 9)):
            x ^= 1 << bit
        found.add(x)
    return sorted(found)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def halves(spark, found):
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1), "high", 1) for x in found]
    return spark.createDataFrame(rows, "high bigint, low bigint, key string, part int")


@pytest.mark.parametrize("tables", [Tables(tile=2048), Tables(tile=7), Tables(radius=3, blocks=8, tile=20), Tables(0, 4), Tables(1, 2)])
def test_all_pairs_within_the_radius(spark, tables):
    found = clustered(tables.tile, 60)
    want = {(x, y): d for i, x in enumerate(found) for y in found[i + 1:] if (d := (x ^ y).bit_count()) <= tables.radius}
    got = near_links(halves(spark, found), tables).collect()
    whole = lambda high, low: (high % (1 << 64)) << 64 | low % (1 << 64)
    pairs = {tuple(sorted((whole(r[0], r[1]), whole(r[2], r[3])))): r[4] for r in got}
    assert len(got) == len(pairs) and pairs == want
    counts = {whole(*r[:2]): r[2] for r in near_counts(halves(spark, found), tables).collect()}
    assert counts == {x: n for x in found if (n := sum(x in p for p in want))}
    assert near_links(halves(spark, found).where("false"), tables).count() == 0


def test_tables_cover_the_radius():
    for wrong in (dict(blocks=7), dict(radius=8), dict(blocks=1, radius=0)):
        with pytest.raises(ValueError):
            Tables(**wrong)


def ordered(rows):
    """By falling id, nulls last; equal ids by the hash that the library takes, which this test leaves open."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def expected(rows):
    rows = ordered(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        a, b = text or "", after or ""
        k = len(a) // 3
        new = a[:len(a) - k] + b[:k]
        yield i, len(a), hashlib.sha256(new.encode()).hexdigest(), *(f"{number(t):032x}" for t in (a, new, b))


def distinct_ids():
    seen = {}
    for i, t in awkward():
        seen.setdefault(i, t)
    return [(i, t) for i, t in seen.items()]


@pytest.mark.parametrize("n", [0, 1, 2, None])
def test_edits(spark, n):
    rows = distinct_ids()[:n]
    got = edits(frame(spark, rows, extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_edits_of_equal_ids(spark):
    """Every row is followed by another row of its id, or of the next one."""
    rows = [(5, "five"), (4, "one two three"), (4, "one two three"), (4, "other words here"), (4, "one two three"), (3, "abcdef")]
    got = edits(frame(spark, rows * 3)).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in rows * 3)
    follows = lambda r: {t for i, t in rows if i in (r["id"], r["id"] - 1 if r["id"] > 3 else 5)}
    assert all(int(r["next_fingerprint"], 16) in {number(t) for t in follows(r)} for r in got)
    assert sorted(r["fingerprint"] for r in got) == sorted(r["next_fingerprint"] for r in got)


def test_long_ranges(spark):
    rows = [(i, prose(40, i % 300)) for i in range(3_000)]
    docs = frame(spark, rows).repartition(13)
    assert sorted(map(tuple, edits(docs).collect()), key=str) == sorted(expected(rows), key=str)


def test_near(spark):
    digits = [f"{x:032x}" for x in clustered(3, 40)] * 2 + [f"{1:032x}", None]
    docs = spark.createDataFrame([(i, d, "x", -1) for i, d in enumerate(digits)], "id int, fingerprint string, _ string, n_near int")
    done = with_near(docs)
    assert done.columns == ["id", "fingerprint", "_", "n_same", "n_near"] and with_near(docs.where("false")).count() == 0
    known = [int(d, 16) for d in digits if d]
    for r in done.collect():
        if r["fingerprint"] is None:
            assert r["n_same"] is None and r["n_near"] is None
        else:
            x = int(r["fingerprint"], 16)
            assert r["n_same"] == known.count(x)
            assert r["n_near"] == sum(0 < (x ^ y).bit_count() <= 6 for y in set(known))


def test_query(spark, tmp_path):
    rows = [r for r in distinct_ids() if r[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_simhash_fingerprints"](spark, str(tmp_path))
    assert got.columns[:7] == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / BITS
    want = [(*r[:5], like(r[3], r[4]), like(r[3], r[5])) for r in expected(rows)]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(want, key=str)


def test_words_are_lower_case():
    assert number("Some WORDS here") == number(lower("Some WORDS here")) and words("a b") == ["a", "b"]
