import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from revlens.llm import packing, sentencepiece_scan, token_files
from revlens.llm.tokens import Encoder, vocabulary_path

VOCABS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def library(name):
    t = Tokenizer.from_file(vocabulary_path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, keep", VOCABS)
def test_encoder_equals_library(name, keep, texts, odd):
    enc, lib = Encoder(vocabulary_path(name), keep), library(name)
    xs = list(texts.values())[:60] + [r.text for r in odd.select("text").collect()]
    for _ in range(2):  # unknown parts first, then all from the table
        assert [x.tolist() for x in enc.encode(xs)] == [lib(x) for x in xs]


@pytest.mark.parametrize("name, keep", VOCABS)
def test_encoder_equals_library_on_any_text(name, keep):
    enc, lib = Encoder(vocabulary_path(name), keep, max_parts=50), library(name)
    alphabet = st.sampled_from(list("aAbé'st 1\t\n\r\x0b\x1c\x85 　.,!<|>ßİΣ日́😀"))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=30), max_size=5))
    def check(xs):
        assert [x.tolist() for x in enc.encode(xs)] == [lib(x) for x in xs]

    check()


def check_packing(rows, texts, lib, length):
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array(lib(t) + [2], "<u4"))
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and 0 < p.length <= length
            at += p.length
        assert at <= length
    for i, all_ids in want.items():
        got = sorted(bytes(p.ids) for p in docs[i])
        cut = []
        for ids in all_ids:
            n = len(ids)
            first = n % length or min(n, length)
            cut += [ids[:first].tobytes()] + [ids[k:k + length].tobytes() for k in range(first, n, length)]
        assert got == sorted(cut)
    return len(bins), sum(len(x) for xs in want.values() for x in xs)


def test_packing_whole_table(documents, texts):
    n, total = check_packing(packing.pack(documents).collect(), texts.items(), library("byte_bpe_50k.json"), 1024)
    assert n <= -(-total // 1024) * 1.03 + 2


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, length=64).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], library("byte_bpe_50k.json"), 64)
    assert [(r.length, r.piece) for r in rows if r.doc_id == 3] == [(1, 0)]
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_two_fit(lengths):
    p = packing.BestTwoFit(50)
    for k, n in enumerate(lengths):
        p.add(n, k)
    bins = list(p.close(0))
    assert sorted(k for b in bins for _, k in b) == list(range(len(lengths)))
    assert all(lengths[k] == n for b in bins for n, k in b)
    assert all(0 < sum(n for n, _ in b) <= 50 for b in bins)


def test_best_two_fit_replaces_the_smallest():
    p = packing.BestTwoFit(10)
    for k, n in enumerate([7, 2, 1, 2]):
        p.add(n, k)
    # 7 + 2 leaves 1, filled by 1; without the 1 a pair fits better.
    assert sorted(n for n, _ in next(p.close(0))) == [1, 2, 7]
    p = packing.BestTwoFit(10)
    for k, n in enumerate([6, 3, 2, 2]):
        p.add(n, k)
    assert sorted(n for n, _ in next(p.close(0))) == [2, 2, 6]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 49407), st.integers(0, 2**32 - 1)), min_size=1, max_size=700),
       st.sampled_from([0.5, 0.9, 0.95, 1.0]))
def test_segments_round_trip(ids, percentile):
    blob = token_files.encode_segment(np.array(ids, np.uint32), percentile)
    assert token_files.decode_segment(blob).tolist() == ids
    if len(ids) > 256:
        assert token_files.decode_segment(blob, 1, 2).tolist() == ids[128:256]  # one block by its index


def test_segments_store_outliers_apart():
    ids = np.full(1280, 7, np.uint32)
    ids[::100] = 40_000
    assert len(token_files.encode_segment(ids)) < 300


def test_token_files_whole_table(spark, documents, texts):
    lib = library("word_bpe_49k.json")
    out = {r.doc_id: r for r in token_files.read(spark, token_files.write(documents)).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array(lib(texts[i]) + [2], "<u4")
        r = out[i]
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_odd_rows(spark, odd, none, monkeypatch):
    lib = library("word_bpe_49k.json")
    rows = sorted(token_files.read(spark, token_files.write(odd, partitions=3)).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for r, (i, t) in zip(rows, want):
        ids = np.array(lib(t) + [2], "<u4")
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, at, ids.tobytes())
        at += len(ids)
    assert len(rows) == len(want)
    assert token_files.read(spark, token_files.write(none)).count() == 0


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_ids_stay_exact(spark, mixed):
    """Nulls beside ids above 2**53 in one batch: every row comes back once, as it was."""
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    lib = library("byte_bpe_50k.json")
    check_packing(packing.pack(mixed, length=64).collect(), rows, lib, 64)
    lib = library("word_bpe_49k.json")
    back = token_files.read(spark, token_files.write(mixed, partitions=3)).collect()
    assert by_id((r.doc_id, bytes(r.ids)) for r in back) == by_id((i, np.array(lib(t) + [2], "<u4").tobytes()) for i, t in rows)
    at = 0
    order = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for r in order:
        assert r.start == at
        at += r.n_tokens


def test_scan_keeps_every_row(pieces, mixed):
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    got = sentencepiece_scan.encode(mixed, chunk=4096).collect()
    assert by_id((r.doc_id, bytes(r.ids)) for r in got) == by_id((i, np.array(pieces.sp.encode(t or ""), "<u4").tobytes()) for i, t in rows)
    assert sum(r.n_chunks > 1 for r in got) == 4


def test_packing_many_small_parts(spark, documents):
    """Tails of many tasks are packed together: close to the lower bound."""
    lib = library("byte_bpe_50k.json")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(120)
    n, total = check_packing(packing.pack(df).collect(), rows, lib, 1024)
    assert n <= -(-total // 1024) * 1.01 + 2


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_scan.Model(vocabulary_path(sentencepiece_scan.MODEL))


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from(list("abetinorsh  é日😀\n\x00.")), max_size=120), st.integers(1, 40))
def test_scan_equals_library(pieces, text, size):
    if text:
        assert sentencepiece_scan.encode_scan(pieces, text, size) == pieces.sp.encode(text)


def test_piece_encoder_equals_library(pieces, texts, odd):
    enc = sentencepiece_scan.PieceEncoder(pieces.sp, max_parts=500)
    alphabet = st.sampled_from(list("abe  \n\té日😀▁\x00.´̈"))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=30), max_size=4))
    def check(xs):
        assert [x.tolist() for x in enc.encode(xs)] == [pieces.sp.encode(x) for x in xs]

    check()
    xs = list(texts.values())[:80] + [r.text or "" for r in odd.select("text").collect()]
    assert [x.tolist() for x in enc.encode(xs)] == pieces.sp.encode(xs)


def test_scan_operators():
    inf = -np.inf  # no path
    mats = [np.array([[0.0, inf]]), np.array([[inf, 0.0], [0.0, 0.0]]), np.array([[0.0], [inf]])]
    assert sentencepiece_scan.product(sentencepiece_scan.product(mats[0], mats[1]), mats[2]).tolist() == [[inf]]
    one_by_one = [mats[0], sentencepiece_scan.product(mats[0], mats[1])]
    got = sentencepiece_scan.scan(mats[:2], sentencepiece_scan.product)
    assert all((a == b).all() for a, b in zip(got, one_by_one))


def test_encode_and_decode(spark, pieces, odd, none, documents):
    for df in (odd, documents.limit(40)):
        rows = df.select("doc_id", "text").collect()
        encoded = sentencepiece_scan.encode(df, giant=500, chunk=97)
        got = sorted((str(r.doc_id), bytes(r.ids)) for r in encoded.collect())
        want = sorted((str(r.doc_id), np.array(pieces.sp.encode(r.text or ""), "<u4").tobytes()) for r in rows)
        assert got == want
        assert encoded.where("n_chunks > 1").count() == sum(len(r.text or "") > 500 for r in rows)
        back = sorted((str(r.doc_id), r.text) for r in sentencepiece_scan.decode(encoded).collect())
        assert back == sorted((str(r.doc_id), pieces.sp.decode(pieces.sp.encode(r.text or ""))) for r in rows)
    assert sentencepiece_scan.encode(none).count() == 0
