import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cladeframe.llm import packing
from cladeframe.llm.packing import best_fit_decreasing, dual_feasible_bound, pack, pack_documents

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def fits(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "It's  a Test, naïve\x1cΣΑΣ <|endoftext|> 123", "é x y"] + ["".join(rng.choice("abcdeé,' \n1") for _ in range(rng.choice([5, 100, 3000]))) for _ in range(60)] + ["word " * 6000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long")
    got = pack_documents(df, PATH, capacity=256, with_ids=True).collect()
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 256)):
            raw = np.array(ids[at : at + 256], "<u4").tobytes()
            want.append((i, k, at, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got)
    bins = fits(got, 256)
    assert bins <= dual_feasible_bound(np.array([w[3] for w in want]), 256) + 1


def test_parts_exchange_until_near_the_bound(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(100, rng.geometric(0.03, 6000))
    df = spark.createDataFrame([(int(i), 0, int(x)) for i, x in enumerate(lengths)], "doc_id long, piece int, length long")
    got = pack(df, capacity=100, part_size=500).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000))
    assert fits(got, 100) <= dual_feasible_bound(lengths, 100) + 3


def test_bounds_are_valid_and_tight():
    rng = np.random.default_rng(2)
    assert dual_feasible_bound(np.array([51] * 7), 100) == 7
    assert dual_feasible_bound(np.array([34] * 6), 100) == 3
    assert dual_feasible_bound(np.array([], np.int64), 100) == 0
    for _ in range(100):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, held = best_fit_decreasing(lengths, 100)
        assert max(held) <= 100 and np.array_equal(np.bincount(bins, lengths), held)
        assert -(-lengths.sum() // 100) <= dual_feasible_bound(lengths, 100) <= len(held)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["It's  a Test,\n\tnaïve <|endoftext|> 123", "", None, "Plain sentence with words."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pack_documents(df, path, with_ids=True).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


def test_rows_without_ids_spread_over_parts(spark):
    df = spark.createDataFrame([(None, 0, 40)] * 3000, "doc_id long, piece int, length long")
    got = pack(df, capacity=100, part_size=500).collect()
    by = defaultdict(int)
    for r in got:
        by[r.sequence_id] += 1
    assert len(got) == 3000 and max(by.values()) == 2 and len(by) == 1500


def test_older_words_are_looked_up_and_not_gone_through():
    class Looked(dict):
        def __iter__(self):
            raise AssertionError("the whole generation is read")

    encoder = packing._Encoder(PATH)
    texts = ["The old words, and (newer) ones: Éa x-1 don't", "the OLD words again"]
    want = list(encoder(texts))
    encoder.parts, encoder.older_parts = {}, Looked(encoder.parts)
    encoder.words, encoder.older_words = {"": b""}, Looked(encoder.words)
    assert list(encoder([*texts, "The New old words,"]))[:2] == want
