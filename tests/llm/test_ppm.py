import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import ppm


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(rows, order):
    """PPM by walking the contexts with explicit sets of excluded bytes."""
    trie = defaultdict(Counter)
    counts = Counter()
    for _, t, train in rows:
        if train:
            w = words(t)
            counts.update([*w, None])
            s = b"\n" * order + b" ".join(w) + b"\x0b"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    trie[s[i - k : i]][s[i]] += 1
    total, distinct = sum(counts.values()), len(counts)

    def logp(s, i):
        barred, lp = set(), 0.0
        for k in range(order, -1, -1):
            left = {c: n for c, n in trie.get(s[i - k : i], {}).items() if c not in barred}
            if not left:
                continue
            if s[i] in left:
                return lp + math.log10((left[s[i]] - 0.5) / sum(left.values()))
            lp += math.log10(len(left) / 2 / sum(left.values()))
            barred |= set(left)
        return lp - math.log10(ppm.ALPHABET - len(barred))

    out = []
    for i, t, train in rows:
        w = words(t)
        s = b"\n" * order + b" ".join(w) + b"\x0b"
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in [*w, None])
        out.append((i, bool(train), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, base, sum(logp(s, i) for i in range(order, len(s)))))
    return out


@pytest.mark.parametrize("order,slice_bytes", [(5, 1500), (3, 1 << 20), (2, 700)])
def test_against_brute_force(spark, monkeypatch, order, slice_bytes):
    monkeypatch.setattr(ppm, "SLICE_BYTES", slice_bytes)
    rng = random.Random(order)
    vocab = ["the", "The", "then", "of", "anon", "né", "ß", "zz\x1cq", "on"]
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(rng.choices(vocab + [f"new{i}"], k=rng.randrange(0, 40))), i % 3 != 1) for i in range(120)]
    rows += [(500, None, True), (501, "", False), (502, " \n", None), (503, "ab " * 5000, False), (7, rows[7][1], rows[7][2]), (None, "the of", False)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, learn boolean, slice int")
    got = ppm.ppm_scores(df, F.col("learn"), order=order, buckets=8).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = brute(rows, order)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one_and_no_training(spark):
    df = spark.createDataFrame([(1, "ab", False), (2, None, False)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in ppm.ppm_scores(df, F.col("learn")).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(ppm.ALPHABET)) and got[1].train_tokens == 0 and got[2].base_score == 0
    assert ppm.ppm_scores(df.limit(0), F.col("learn")).count() == 0


def test_a_slice_is_counted_in_bounded_memory():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(20000)]
    texts = [" ".join(rng.choices(vocabulary, k=300)).encode() for _ in range(4000)]
    group = pa.table({"slice": pa.array([0] * len(texts)), "train": pa.array([True] * len(texts)), "text": pa.array(texts, pa.binary())})
    tracemalloc.start()
    found = ppm._wanted(group, 5, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = [np.frombuffer(c, "<u4").sum() for k, c in zip(found["kind"].to_pylist(), found["counts"].to_pylist()) if k == ppm.GRAMS]
    assert sum(counts) == sum(map(len, texts)) + len(texts)  # every byte and an end
    assert peak < 20 * sum(map(len, texts))
