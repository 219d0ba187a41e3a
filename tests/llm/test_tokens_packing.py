"""Operators 2 and 5 against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gneiss.llm import bpe, packing, queries, tokens
from tests.llm import cases

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab's \n\t'.,1é½日 lrevmdT<|endoftx>", max_size=40), max_size=6))
def test_both_encoders_equal_the_library(data):
    for path, backtracking in ((BYTE, True), (WORD, False)):
        library = Tokenizer.from_file(path) if not hasattr(test_both_encoders_equal_the_library, path) else getattr(test_both_encoders_equal_the_library, path)
        setattr(test_both_encoders_equal_the_library, path, library)
        ids, bounds = bpe.text_encoder(path, backtracking)(data)
        for text, a, b in zip(data, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_and_forgetting():
    rng = random.Random(1)
    data = ["".join(rng.choice("etaoin") for _ in range(n)) for n in (1, 63, 64, 65, 500, 4000)]
    for path, backtracking in ((BYTE, True), (WORD, False)):
        v = bpe.vocabulary(path)
        encoder = bpe.TextEncoder(v, bpe.BacktrackingEncoder(v) if backtracking else bpe.MergeEncoder(v), not v.suffix, bpe.lowered if v.suffix else None, keep=2)
        for _ in range(3):
            ids, bounds = encoder(data)
            for text, a, b in zip(data, bounds, bounds[1:], strict=False):
                assert ids[a:b].tolist() == ids_of(path, text)


def test_round_trip_query(spark, tmp_path):
    folder = cases.write(cases.documents(spark), tmp_path, "documents")
    got = queries.op5_bpe_round_trip(spark, folder).collect()
    want = []
    library = Tokenizer.from_file(BYTE)
    for i, t in cases.texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_decode_of_lists(spark):
    df = spark.createDataFrame([(1, [40, 257]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tokens.decode(df, BYTE).collect()}
    assert got[1] == Tokenizer.from_file(BYTE).decode([40, 257]) and got[2] == got[3] == ""


def check_packing(rows, data):
    want = {}
    for i, t in data:
        ids = [*ids_of(WORD, t), 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            key = (i, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing_query(spark, tmp_path):
    folder = cases.write(cases.documents(spark), tmp_path, "documents")
    rows = queries.op2_best_fit_packing(spark, folder).collect()
    n = check_packing(rows, cases.texts())
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_levels_and_empty_table(spark):
    rng = random.Random(2)
    lengths = [(i, rng.choice([1, 5, 700, 900, 1025, 1400, 2048])) for i in range(700)]
    df = spark.createDataFrame(lengths, "doc_id long, length long")
    rows = packing.pack(df, 2048, group=50).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(lengths)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
    assert packing.pack(packing.pieces(cases.nothing(spark), WORD)).count() == 0


def squares(bins, lengths):
    return int((np.bincount(bins, weights=lengths) ** 2).sum())


def test_local_search_empties_bins():
    lengths = np.array([5, 4, 3, 6, 3, 3])  # first fit opens [5 4 3] [6 3 3]; as few as there can be
    bins = packing.first_fit(lengths, 12)
    assert packing.improve(bins, lengths, 12) == 0 and len(set(bins)) == 2
    lengths = np.array([7, 7, 3, 2, 5])  # [7 3 2] [7 5]
    bins = np.array([0, 1, 0, 2, 2])  # fills 10, 7, 7
    assert packing.improve(bins, lengths, 12) > 0 and len(set(bins)) == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(0, 2**32 - 1))
def test_local_search_keeps_items_and_raises_squares(data, seed):
    lengths = np.array(data, dtype=np.int64)
    bins = packing.first_fit(lengths, 20)
    order = np.random.default_rng(seed).permutation(len(data))  # any order, any start
    alone = np.arange(len(data)) if seed % 2 else bins
    bins, lengths = alone.copy(), lengths[order] if seed % 2 else lengths
    before, count = squares(bins, lengths) if len(bins) else 0, len(set(bins.tolist()))
    packing.improve(bins, lengths, 20)
    if len(bins):
        assert np.bincount(bins, weights=lengths).max() <= 20
        assert squares(bins, lengths) >= before and len(set(bins.tolist())) <= count
        assert len(set(bins.tolist())) >= -(-lengths.sum() // 20)


def test_local_search_does_the_work_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = np.array([r.length for r in packing.pieces(docs, WORD).select("length").collect()])
    bins = packing.first_fit(lengths, 2048)
    start, least = len(set(bins.tolist())), -(-lengths.sum() // 2048)
    made = packing.improve(bins, lengths, 2048)
    assert made > 0 and start > least and least <= len(set(bins.tolist())) <= least + 1


def test_tries_that_fail_end_soon():
    began = time.perf_counter()
    for lengths in (np.full(2000, 1025), np.random.default_rng(1).integers(700, 1100, 2000), np.random.default_rng(2).integers(500, 700, 2000)):
        packing.improve(packing.first_fit(lengths, 2048), lengths, 2048)
    assert time.perf_counter() - began < 30


def test_equal_rows_spread_over_groups(spark):
    df = spark.createDataFrame([(1, 700)] * 6000, "doc_id long, length long")
    rows = packing.pack(df, 2048, group=500).collect()
    fill, groups = {}, {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + 1
        groups[r.sequence_id >> 24] = groups.get(r.sequence_id >> 24, 0) + 1
    assert len(rows) == 6000 and set(fill.values()) <= {1, 2} and sum(v == 1 for v in fill.values()) <= 1
    first = [n for g, n in groups.items() if g >> 34 == 0]
    assert len(first) == 12 and max(first) < 2 * min(first)


def test_tiny_pieces_over_levels(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "1L AS length", "id AS sequence_id")
    rows = packing.pack(df, 64, group=100, carried=2).collect()
    assert len(rows) == 9000 and len({r.sequence_id for r in rows}) <= -(-9000 // 64) + 1
