import random

from corpusmap.llm.repeats import substring_dedup
from tests.llm.common import awkward, frame, prose, words


def brute(rows, window):
    import xxhash

    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh3_64_intdigest((r[1] or "").encode())))
    seen, out = set(), []
    for doc, text in ranked:
        found, gone = words(text), set()
        for i in range(len(found) - window + 1):
            key = tuple(found[i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(found) if i not in gone)
        out.append((doc, len(found), len(gone), kept))
    return sorted(out, key=str)


def run(spark, rows, window, **options):
    got = substring_dedup(frame(spark, rows), window=window, **options).collect()
    return sorted((tuple(r) for r in got), key=str)


def planted():
    rng = random.Random(6)
    passage = prose(70, 777)
    rows = [(i, prose(50, 500 + i) + (" " + passage + " " + prose(9, i) if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice("a b c".split()) for _ in range(200))) for i in range(4)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    assert run(spark, planted(), 20) == brute(planted(), 20)
    assert run(spark, planted(), 3) == brute(planted(), 3)
    assert run(spark, awkward(), 20) == brute(awkward(), 20)


def test_small_sketches_and_many_shards_lose_nothing(spark):
    # One cell per four windows: nearly every window is estimated as repeated, the exact pass decides.
    assert run(spark, planted(), 20, cells_per_window=1, shard_windows=50) == brute(planted(), 20)


def test_rows_in_other_partitions(spark):
    docs = frame(spark, planted()).repartition(7)
    got = sorted((tuple(r) for r in substring_dedup(docs).collect()), key=str)
    assert got == brute(planted(), 20)


def test_columns_and_empty(spark):
    assert substring_dedup(frame(spark, awkward(), extra=True)).count() == len(awkward())
    assert substring_dedup(frame(spark, [])).count() == 0
    assert run(spark, [(1, "a b"), (2, None)], 20) == [(1, 2, 0, "a b"), (2, 0, 0, "")]
