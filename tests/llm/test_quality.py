import random
import string

from corpusmap.llm.quality import Bands, keep_good, quality_rules
from tests.llm.common import awkward, frame, words

LETTERS = "eeeeeeeeeeeetttttttttaaaaaaaaooooooooiiiiiiinnnnnnnsssssshhhhhhrrrrrrddddllllcccuuummmwwffggyyppbbvk"
BASE64 = string.ascii_letters + string.digits + "+/"
ASCII = "".join(map(chr, range(33, 127)))


def sentences(size, rng):
    """Prose of `size` bytes: a vocabulary of 3000 words by letter frequencies, short words more often."""
    spell = random.Random(11)
    vocabulary = ["".join(spell.choices(LETTERS, k=1 + round(i ** 0.25) + spell.randint(0, 2))) for i in range(3000)]
    weights = [1 / (i + 2) for i in range(3000)]
    return " ".join(rng.choices(vocabulary, weights, k=size))[:size].strip()


def noise(size, alphabet, rng, longest=12):
    found = " ".join("".join(rng.choices(alphabet, k=rng.randint(2, longest))) for _ in range(size // 3))
    return found[:size].strip()


def brute(text):
    found = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    times = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else None
    if times is None:
        times = {}
        for g in grams:
            times[g] = times.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_counts_equal_brute_force(spark):
    rows = awkward() + [(40, "a b c d e f g\nx\na b c d e f g\nx\n\n\n"), (41, "## | <b> $5 & 100% *"), (42, "z " * 9)]
    got = quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got):
        q = r["quality"]
        expected = brute(text)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == expected, doc
        assert q["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (q["kept"] and q["base_failed"])


def test_bands_reject_repetitive_and_random_text(spark):
    import random

    rng = random.Random(5)
    noise = " ".join("".join(chr(rng.randint(33, 0x2FF)) for _ in range(40)) for _ in range(150))
    numbers = " ".join(f"row {i} value ok" for i in range(1500))
    half = awkward()[11][1] + " " + " ".join(f"entry {i % 7} {i}" for i in range(4000))
    rows = [(1, awkward()[5][1]), (2, noise), (3, numbers), (4, half), (5, awkward()[-9][1])]
    got = {r["doc_id"]: r["quality"] for r in quality_rules(frame(spark, rows), Bands(repeat_percent=100)).collect()}
    assert got[1]["kept"]
    assert not got[2]["kept"] and got[2]["ratio"] < 1.4
    assert not got[3]["kept"] and got[3]["ratio"] > 3.5
    assert not got[4]["kept"]


def test_other_columns_stay_and_empty_tables(spark):
    docs = frame(spark, awkward(), extra=True)
    kept = keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules(docs, into="n").columns == docs.columns
    assert keep_good(docs.where("false")).count() == 0


def test_half_junk_of_two_chunks_and_more_falls(spark):
    rng = random.Random(8)
    rows = [(i, sentences(1500 + 500 * i, rng)) for i in range(14)]
    for i in range(12):
        half = 1600 + 200 * i  # texts of 3 to 8 KB
        rows.append((100 + i, sentences(half, rng) + " " + noise(half, ASCII, rng)))
        rows.append((200 + i, noise(half, BASE64, rng) + " " + sentences(half, rng)))
        rows.append((300 + i, sentences(half, rng) + " " + "".join(rng.choices(ASCII, k=1100 + 50 * i)) + " " + sentences(500, rng)))
    rows += [(400, sentences(4096, rng) + " " + noise(3900, ASCII, rng)), (401, sentences(4096, rng) + " " + "x" * 2500)]
    got = {r["doc_id"]: r["quality"] for r in quality_rules(frame(spark, rows)).collect()}
    assert all(q["kept"] == (doc < 100) for doc, q in got.items()), [d for d, q in got.items() if q["kept"] != (d < 100)]
    assert got[0]["odd_chunks"] == 0 and got[400]["odd_chunks"] >= 0.4


def test_random_text_falls_in_every_band_and_prose_stays(spark):
    rng, rows = random.Random(9), []
    edges = [*(int(b[0]) for b in Bands().limits[:-1]), 20_000]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        for k in range(8):
            size = rng.randint(low, high - 1)
            rows.append((1000 * i + k, sentences(size, rng)))
            rows += [(1000 * i + 100 + 10 * k + j, noise(size, alphabet, rng, longest))
                     for j, (alphabet, longest) in enumerate([(BASE64, 8), (ASCII, 8), (BASE64, 12), (ASCII, 12)])]
    # A blob inside a long text: a third of its chunks.
    rows += [(90_000, sentences(20_000, rng) + " " + noise(10_000, BASE64, rng) + " " + sentences(1000, rng))]
    rows += [(90_001, sentences(20_000, rng) + " " + "".join(rng.choices(BASE64, k=10_000)))]
    limits = Bands(min_words=1)
    got = {r["doc_id"]: r["quality"] for r in quality_rules(frame(spark, rows), limits).collect()}
    wrong = {d: (q["ratio"], q["n_words"]) for d, q in got.items() if q["kept"] != (d < 90_000 and d % 1000 < 100)}
    assert not wrong
    assert got[90_000]["odd_chunks"] > 0.25 and got[90_001]["odd_chunks"] > 0.25
