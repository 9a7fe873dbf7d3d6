import random
import re
from collections import Counter

import numpy as np

from cladeframe.llm import decontamination as D


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(docs, items, k=5, least=0.8):
    out = {}
    for i, t in docs:
        w = words(t)
        for item, u in items:
            v = words(u)
            if not w or not v:
                continue
            own = min(k, len(v))
            grams = lambda x: Counter(tuple(x[j : j + own]) for j in range(len(x) - own + 1))
            g = grams(v)
            best = (0, 0)
            for s in range(max(1, len(w) - len(v) + 1)):
                h = grams(w[s : s + len(v)])
                both = sum((g & h).values())
                best = max(best, (both / max(1, sum(g.values()) + sum(h.values()) - both), -s))
            if best[0] >= least:
                out[i, item] = (round(best[0], 9), -best[1])
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["The", "of", "É"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 9, 30, 60])))) for i in range(30)] + [(90, None), (91, " "), (92, "One"), (93, "la la la la la la la la la la")]
    docs = []
    for i in range(160):
        t = rng.choices(vocab, k=rng.randrange(0, 120))
        if i % 2:
            v = (rng.choice(items[:30])[1]).split()
            for _ in range(i // 2 % 3):
                v[rng.randrange(len(v))] = "changed"
            if i % 5 == 0:
                v = v[1:]
            t[i % 40 : i % 40] = [x.upper() if i % 3 else x for x in v]
        docs.append((i, (" \n" if i % 7 else "\t").join(t)))
    docs += [(500, None), (501, ""), (502, "one"), (502, "one"), (503, "la la la la la la la la la la la la"), (None, "One"), (504, "x " * 30_000 + items[4][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*d, 1) for d in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for block in (8192, 7):
        rows = D.contaminated(df, bench, items_per_block=block).collect()
        assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in rows} == want
        assert sum(r.doc_id == 502 for r in rows) == 2
    assert len(want) > 25
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_window_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**64, 30, dtype=np.uint64)
    for at, fp in enumerate(D._window_simhashes(s, 9).tolist()):
        h = s[at : at + 9].tolist()
        assert fp == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 9)


def test_index_finds_all_within_the_radius_and_selects():
    rng = np.random.default_rng(4)
    own = rng.integers(0, 2**64, 100, dtype=np.uint64)
    bits = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    near = np.array([x ^ bits(n) for x in own for n in (1, 5, 10, 15, 18, 19, 20, 24)])
    windows = np.concatenate([own, near, rng.integers(0, 2**64, 2000, dtype=np.uint64)])
    index = D._Blocks(own, 19)
    far = np.bitwise_count(windows[:, None] ^ own)
    for first, last in ((0, 100), (13, 14), (5, 77)):
        w, i, d = index.within(windows, first, last)
        want = {(a, b + first) for a, b in zip(*np.nonzero(far[:, first:last] <= 19))}
        assert set(zip(w.tolist(), i.tolist())) == want and (d == far[w, i]).all()
    w, i = index.candidates(windows[-2000:], 0, 100)
    assert 0.1 < len(w) / 200_000 < 0.2  # unrelated pairs met: a seventh


def test_a_text_made_of_many_items_takes_bounded_memory():
    """2,048 items, and a text of 100,000 words that repeats them: arrays stay far below windows times items."""
    import tracemalloc

    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(30)).encode()) for i in range(2048)]
    text = b" ".join(items[i % 2048][1] for i in range(3334))
    index = D._Index(items, 5, 19)
    tracemalloc.start()
    found = {m[0]: m for m in index.matches(text, 0.8)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2048 and all(found[i][1] == 1.0 and found[i][3] == 30 * i for i in range(2048)) and peak < 300e6
