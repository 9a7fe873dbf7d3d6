import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cladeframe.llm import suffix_dedup as S


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = S._runs(gone)
        out.append((len(t), int(gone.sum()), len(spans[0]), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def fixture(rng, n, alphabet="abcd é\n"):
    text = lambda m: "".join(rng.choice(alphabet) for _ in range(m))
    passages = [text(rng.choice([30, 60, 90, 200])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut:], text(rng.randrange(0, 90))]
        rows.append("".join(parts))
    rows += [rows[3], rows[3], rows[5] + "x", "a" * 400, "ab" * 150 + "c", "\0" * 90, "b\0\0" * 40, "", None, "z" * 39, "z" * 40, text(500) * 2]
    return rows


@pytest.mark.parametrize("part_bytes", [8 << 20, 3000, 200])
def test_against_brute_force(spark, part_bytes):
    rng = random.Random(part_bytes)
    rows = [(i, t, 1) for i, t in enumerate(fixture(rng, 120))] + [(3, None, 1), (None, "q" * 50, 2), (700, "long " * 1000, 3)]
    rows.append(rows[9])
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = S.repeated_spans(df, length=40, anchor=12, part_bytes=part_bytes).collect()
    want = [(i, *w) for (i, _, _), w in zip(rows, brute([(t or "").encode() for _, t, _ in rows], 40))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert S.repeated_spans(df.limit(0)).count() == 0


def test_many_identical_rows(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text)] * 500 + [(2, text[100:200] + "!"), (3, "x" + text[1000:1300] + "y"), (4, text[1500:])]
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 3000, 3000, 1, 500), (2, 101, 0, 0, 1), (3, 302, 300, 1, 1), (4, 1500, 1500, 1, 1)]


def test_suffix_array_flags_repeats():
    rng = random.Random(7)
    for trial in range(60):
        alphabet = b"ab" if trial % 2 else b"abc\0\xff"
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(rng.randrange(1, 12))]
        if trial % 3 == 0:
            texts += [texts[0], b"a" * 60]
        length = rng.choice([8, 9, 13])
        windows = [max(0, len(t) - length + 1) if rng.random() < 0.7 else min(5, max(0, len(t) - length + 1)) for t in texts]
        counts = Counter(t[i : i + length] for t, n in zip(texts, windows) for i in range(n))
        want = [[counts[t[i : i + length]] > 1 for i in range(n)] for t, n in zip(texts, windows)]
        assert [f.tolist() for f in S.repeated_windows(texts, windows, length)] == want


@pytest.mark.parametrize("bits", [9, 11, 20])
def test_every_window_has_one_run_and_equal_windows_equal_anchors(monkeypatch, bits):
    monkeypatch.setattr(S, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    texts = [(t or "").encode() for t in fixture(rng, 30)] + [b"xy " * 900]
    seen, anchor = Counter(), {}
    for block in S.anchors(texts, 40, 12):
        for text, start, n, h in zip(*(x.tolist() for x in block)):
            for s in range(start, start + n):
                seen[text, s] += 1
                assert anchor.setdefault(texts[text][s : s + 40], h) == h
    assert set(seen.values()) == {1}
    assert set(seen) == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 39)}
