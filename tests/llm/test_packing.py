import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmap.llm.packing import END_ID, Encoder, pack, sequences, sum_of_squares
from tests.llm.common import awkward, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [END_ID]


def check_encoder(texts):
    ids, sizes = ENCODER.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == ids_of(text), text


def test_encoder_equals_the_tokenizer():
    check_encoder(["", " ", "Hello, World. it's 12.5% don't'll .,. a.b", "İstanbul ÀÉ é Σίσυφος ΣΑΣ", "x y z",
                   "<|endoftext|>a <|startoftext|> b", "word, word. Word,. WORD ½ 漢字 かな ª º", "a" * 3000, "\x1f\x00 ok"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_encoder_on_any_text(texts):
    check_encoder([t.encode("utf-8", "ignore").decode() for t in texts])


def test_encoder_on_every_letter_before_marks():
    """Whatever normal forms and lower case make of a letter, marks behind it are the tokenizer's."""
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    few = letters if len(letters) < 8_000 else [c for c in letters if ord(c) < 0x3000 or 0xF900 <= ord(c) < 0x11000]
    for end in (".", ",", "a.", ".,"):
        words = [c + end for c in few] + ["x" + c + end for c in few]
        ids, sizes = Encoder(PATH).encode(pa.array(words))
        want = [e.ids + [END_ID] for e in TOKENIZER.encode_batch(words, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_encoder_on_words_of_many_scripts():
    check_encoder(["ALİ. İKİ, bir", "\u0958. \u05e9\u05c1, \ufb2a.", "CAFÉ. Été, ÞÓR. straße, STRASSE.", "a-. ½. 7, x9. ...", "ΟΔΟΣ. ΟΔΟΣa, ᾳ."])


def test_sum_of_squares_takes_the_best_place():
    """Against the definition: try every open bin and a new one."""
    rng = random.Random(2)
    sizes, capacity = [rng.randint(1, 19) for _ in range(300)], 20
    bins, offsets, gaps = sum_of_squares(np.array(sizes), capacity)
    levels = []

    def cost(state):
        counts = {}
        for level in state:
            counts[level] = counts.get(level, 0) + (level < capacity)
        return sum(c * c for c in counts.values())

    for size, b, offset in zip(sizes, bins.tolist(), offsets.tolist()):
        options = [cost(levels[:i] + [x + size] + levels[i + 1:]) for i, x in enumerate(levels) if x + size <= capacity]
        options.append(cost([*levels, size]))
        if b == len(levels):
            levels.append(0)
        assert levels[b] == offset
        levels[b] += size
        assert levels[b] <= capacity and cost(levels) == min(options)
    assert (capacity - np.array(levels) == gaps).all()


def check(rows, pieces, capacity, with_ids=False):
    got = [r.asDict() for r in pieces.collect()]
    expected = sorted(
        (str(doc), k, k * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for doc, text in rows for ids in [ids_of(text)] for k in range(-(-len(ids) // capacity))
        for part in [ids[k * capacity:(k + 1) * capacity]])
    assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


def test_pieces_and_sequences(spark):
    rows = awkward()
    for capacity in (64, 4096):
        used, least = check(rows, pack(frame(spark, rows, extra=True), PATH, capacity), capacity)
        assert used <= least * 1.1 + 1


def test_many_documents_over_several_levels(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["the"] * rng.randint(0, 120))) for i in range(4000)]
    docs = frame(spark, rows).repartition(8)
    used, least = check(rows, pack(docs, PATH, 128, window=200, spare=1), 128)
    assert used <= 1.05 * least
    stuck = [(i, " ".join(["the"] * 70)) for i in range(900)]  # no two fit
    used, _ = check(stuck, pack(frame(spark, stuck), PATH, 128, window=100), 128)
    assert used == 900


def test_round_trip_of_sequences(spark):
    rows = awkward()[:14]
    packed = pack(frame(spark, rows), PATH, 128, with_ids=True).cache()
    ids = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    back = {}
    for r in packed.collect():
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
        back.setdefault(r["id"], {})[r["piece"]] = r["ids"]
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in back.items()} == {d: ids_of(t) for d, t in rows}


def test_empty_table(spark):
    assert pack(frame(spark, []), PATH).count() == 0
