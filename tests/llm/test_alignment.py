import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from corpusmap.llm import queries, work
from corpusmap.llm.alignment import (
    BLOCKS_A_FILE, Both, ByteLevel, Pieces, _flat, align, aligned, aligned_parts, byte_letters, links,
)
from corpusmap.llm.csr import Csr
from corpusmap.llm.segments import Lookup, segments
from tests.llm.common import awkward, frame, prose

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
MARKED = "a▁b"


@pytest.fixture(scope="module")
def both():
    return Both(A, B)


@pytest.fixture(scope="module")
def plain():
    """Whole texts through the tokenizers themselves: (ids, ends of tokens in bytes) of each, or nothing."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    number = {c: n for n, c in byte_letters().items()}

    def tokens(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(number[c] for c in a.id_to_token(i)) for i in ids[0]], [
            bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            return None
        return [list(zip(i, np.cumsum([len(x) for x in r]).tolist(), [len(x) for x in r])) for i, r in zip(ids, raw)]

    return tokens


def overlaps(found):
    """(place, place, id, id, shared bytes) of all overlapping tokens, pair by pair."""
    out, (a, b) = [], found
    for i, (x, end_x, n_x) in enumerate(a):
        for j, (y, end_y, n_y) in enumerate(b):
            shared = min(end_x, end_y) - max(end_x - n_x, end_y - n_y)
            if shared > 0:
                out.append((i, j, x, y, shared))
    return out


def groups(found):
    out, (a, b) = [], found
    start = 0
    for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
        out.append([[str(i) for i, e, _ in side if start < e <= end] for side in (a, b)])
        start = end
    return ";".join("|".join(",".join(side) for side in g) for g in out), sum(len(x) * len(y) for x, y in out)


def expected(docs, plain):
    found = [(i, plain(t)) for i, t in docs]
    count = Counter((x, y) for _, f in found if f for _, _, x, y, _ in overlaps(f))
    peak = Counter()
    for (_, y), n in count.items():
        peak[y] = max(peak[y], n)
    for i, f in found:
        if f is None:
            yield (i, 0, 0, 0, 0, 0, 0, 0, "")
        else:
            pairs, (text, n_group_links) = [p[2:4] for p in overlaps(f)], groups(f)
            yield (i, len(f[0]), len(f[1]), text.count(";") + 1, len(pairs), n_group_links,
                   sum(count[p] == peak[p[1]] for p in pairs), sum(count[p] for p in pairs), text)


CASES = [
    "plain words, with marks. And MORE!", "don't we'll I'd 's x's", "a  b", " a", "a ", " ", "\n", "a\n b", "a \n \n b",
    "x   y", "　 　", "<|endoftext|> </s> <0x41> <unk>", "naïve ÉTÉ coût", "日本語 текст עברית",
    "😀😀 a😀", "12345 3.14 1e5", "tab\there", "́x é́", "a\x00b", "​ z ‍", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "ﬁ ﬃ ①", "x ...", ". , ;", "﻿x", "    y", "----------- ======", "a\r\nb", "ß ẞ ŉ",
]


@pytest.mark.parametrize("text", CASES)
def test_segments_have_the_tokens_of_the_text(both, plain, text):
    check_tokens(both, plain, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé. ,\n\t1<>| 　 日😀-́ÀĿ")), max_size=24))
def test_segments_have_the_tokens_of_any_text(both, plain, text):
    check_tokens(both, plain, text)


def check_tokens(both, plain, text):
    codes, sizes, table = both.tokenized(pa.array([text]))
    rows = table.take(pa.array(codes)).to_pylist()
    whole = plain(text)
    assert sizes.tolist() == [len(codes)] and (bool(rows) and all(r["good"] for r in rows)) == (whole is not None)
    if whole:
        assert [[i for r in rows for i in r[side]] for side in "ab"] == [[i for i, _, _ in w] for w in whole]


def test_texts_that_are_not_spelled(both, plain):
    _, _, table = both.tokenized(pa.array([MARKED]))
    assert table.column("good").to_pylist() == [False] and plain(MARKED) is None


def test_long_runs_of_blanks_are_one_segment():
    coded, sizes = segments(pa.array(["a b", "a  b", "", "c a", " x"]))
    assert sizes.tolist() == [2, 1, 0, 2, 1]
    assert [coded.dictionary[i].as_py() for i in coded.indices.to_pylist()] == ["a", "b", "a  b", "c", "a", " x"]


def test_lookup_forgets():
    calls = []
    encoders = [lambda found: calls.append(found) or [[len(w)] * len(w) for w in found], lambda found: [[7]] * len(found)]
    lookup = Lookup(encoders, limit=5)
    for found in (["a", "bb"], ["bb", "cccc"], ["a"], ["cccc", "a"]):
        (ids, sizes), (other, ones) = lookup(found)
        assert sizes.tolist() == [len(w) for w in found] and ids.tolist() == [len(w) for w in found for _ in range(len(w))]
        assert other.tolist() == [7] * len(found) and ones.tolist() == [1] * len(found)
    assert calls == [["a", "bb"], ["cccc"], ["a"], ["cccc"]]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 30))
def test_products(seed, limit):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((5, 7), (7, 4)))
    x, y = np.maximum(x, 0), np.maximum(y, 0)
    sparse = lambda m: Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), m.nonzero()[1], m[m.nonzero()], m.shape[1])
    dense = np.zeros((5, 4), np.int64)
    for rows, cols, values in sparse(x).product_parts(sparse(y), limit):
        assert len(set(zip(rows.tolist(), cols.tolist()))) == len(rows)
        dense[rows, cols] += values
    assert (dense == x @ y).all()
    whole = sparse(x) @ sparse(y)
    assert (whole.starts[-1], whole.height, whole.width) == (np.count_nonzero(x @ y), 5, 4)
    back = sparse(x).transposed()
    assert (back.height, back.width) == (7, 5) and (back.rows() == x.T.nonzero()[0]).all() and (back.cols == x.T.nonzero()[1]).all()


def docs_of_all_kinds():
    short = [(i, t[:1500] if t else t) for i, t in awkward()]
    return short + [(100 + i, t) for i, t in enumerate(CASES)] + [(300, MARKED), (300, CASES[0]), (None, "a")]


def test_rows(spark, plain):
    rows = docs_of_all_kinds()
    docs = frame(spark, rows, extra=True)
    got = align(docs, A, B, block_bytes=2_000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows, plain), key=str)
    assert align(docs.where("false"), A, B).count() == 0


def test_links(spark, plain):
    rows = [(i, t) for i, t in docs_of_all_kinds() if t is None or len(t) < 300]
    docs = frame(spark, rows)
    want = Counter((i, *o) for i, t in rows if (f := plain(t)) for o in overlaps(f))
    assert Counter(map(tuple, links(docs, A, B).collect())) == want
    n = sum(groups(f)[1] for _, t in rows if (f := plain(t)))
    assert links(docs, A, B, shared_groups=True).count() == n


def test_long_text(spark):
    text = "lomi kaé. tén\n" * 30_000
    row = align(frame(spark, [(1, text), (2, "lomi")]), A, B).where("id = 1").first()
    assert row["n_links"] >= max(row["n_a"], row["n_b"]) >= row["n_groups"] > 60_000


def test_query(spark, plain, tmp_path):
    rows = [r for r in docs_of_all_kinds() if r[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], r[1], r[2], r[3], r[4], r[6], r[7], hashlib.sha256(r[8].encode()).hexdigest() if r[8] else "")
            for r in expected(rows, plain)]
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == sorted(want, key=str)


def test_files_hold_few_blocks(spark, monkeypatch):
    written, save = {}, work.save
    monkeypatch.setattr(work, "save", lambda df, name, **more: written.setdefault(name, save(df, name, **more)))
    rows = [(i, f"lomi kaé {i}") for i in range(30)]
    assert align(frame(spark, rows).coalesce(1), A, B, block_bytes=1).count() == 30
    files = [r["count"] for r in written["aligned"].groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 30 and max(files) <= BLOCKS_A_FILE


def test_texts_without_segments(spark):
    got = align(frame(spark, [(1, None), (2, "")]).coalesce(1), A, B).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


@pytest.mark.parametrize("max_bytes", [1, 7, 40, 300, 1 << 20])
def test_parts_are_the_whole(both, max_bytes):
    _, _, table = both.tokenized(pa.array([*CASES, MARKED, "x" * 300, "lomi kaé tén"]))
    lists = [table.column(c).to_pylist() for c in "ab"]
    flat = [x for side in lists for x in (np.array(sum(side, []), np.int64), np.array(list(map(len, side)), np.int64))]
    parts, whole = list(aligned_parts(*flat, both.lengths, max_bytes)), aligned(table, both.lengths)
    assert len(parts) == 1 if max_bytes == 1 << 20 else len(parts) > 1
    got = [[x for p in parts for x in value(p)] for value in PARTS]
    assert got == [list(value(whole)) for value in PARTS]


PARTS = [
    lambda p: p.sizes_a.tolist(), lambda p: p.sizes_b.tolist(), lambda p: p.n_groups().tolist(), lambda p: p.n_group_links().tolist(),
    lambda p: p.groups().to_pylist(),
    lambda p: [x for row, col, shared in p.links() for x in zip(p.a[row].tolist(), p.b[col].tolist(), shared.tolist())],
]


def test_links_of_a_block_take_little_memory(both):
    """Arrays that stand for bytes are for some segments at a time, not for the whole block."""
    _, _, table = both.tokenized(pa.array([" ".join(f"{w}{i}" for i, w in enumerate(prose(120_000, 1).split()))]))
    (a, n_a), (b, n_b) = (_flat(table.column(c).combine_chunks()) for c in "ab")
    tracemalloc.start()
    n = sum(len(row) for part in aligned_parts(a, n_a, b, n_b, both.lengths) for row, _, _ in part.links())
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    assert n == sum(len(row) for row, _, _ in aligned(table, both.lengths).links())
    _, whole = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert 3 * peak < whole


def test_vocabularies():
    a, b = ByteLevel(A), Pieces(B)
    assert len(a.pieces) == 50_257 and a.pieces[50_256] == b"<|endoftext|>" and len(b.pieces) == 32_000
    assert b"\n" in a.pieces and b.pieces[3] == b"\x00" and all(a.pieces) and all(b.pieces)
