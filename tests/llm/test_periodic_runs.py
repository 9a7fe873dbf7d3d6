"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from cladeframe.llm import periodic_runs as P


def brute(words, least_length=24, least_exponent=3):
    n, out = len(words), set()
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least_length, least_exponent * q) and not any(words[i : i + length - p] == words[i + p : i + length] for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def document(rng, most):
    words = []
    while len(words) < rng.randint(0, most):
        unit = [b"%d" % rng.randint(0, rng.choice([1, 2, 5, 90])) for _ in range(rng.randint(1, 12))]
        words += (unit * rng.randint(1, 7))[: rng.randint(1, 70)]
    return words


@pytest.mark.parametrize("bounds", [(24, 3), (6, 2), (10, 2), (20, 4)])
def test_runs(bounds):
    rng = random.Random(sum(bounds))
    for _ in range(60):
        docs = [document(rng, 200) for _ in range(rng.randint(1, 8))]
        assert P.periodic_runs(docs, *bounds) == [brute(d, *bounds) for d in docs]


def test_long_periods_and_squares():
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[-1]) < 3000:
        fibonacci += (fibonacci[-1] + fibonacci[-2],)
    docs = [[b"a"] * 5000, [b"%d" % (i % 700) for i in range(2600)], fibonacci[-1][:1500], [b"%d" % i for i in range(500)], [b"a"] * 23, [b"a"] * 24]
    assert P.periodic_runs(docs) == [brute(d) for d in docs]
    assert P.periodic_runs([]) == [] and P.periodic_runs([[]]) == [[]]


def test_equal_hashes_change_nothing(monkeypatch):
    rng = random.Random(1)
    docs = [document(rng, 120) for _ in range(20)]
    monkeypatch.setattr(P, "_gram_hashes", lambda words, n: (words[: len(words) - n + 1] * 0).astype("uint64"))
    assert P.periodic_runs(docs) == [brute(d) for d in docs]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, *sha)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_WORDS", 500)
    rng = random.Random(2)
    docs = [(i, rng.choice([" ", "\n", " \t\x0b"]).join(w.decode() for w in document(rng, 150)), i, "x") for i in range(300)]
    docs += [(900, None, 1, "x"), (901, "", 1, "x"), (902, " \r\n ", 1, "x"), (903, "é " * 400, 1, "x")] + [docs[5]] * 20
    table = spark.createDataFrame(docs, "doc_id long, text string, start int, runs string")
    got = P.find_runs(table, plant=True)
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((expected(i, t) for i, t, *_ in docs), key=str)
    assert all([(x.start, x.length, x.period) for x in r.runs] == brute((t or "").encode().split()) for r, (_, t, *_) in zip(sorted(P.find_runs(table).collect(), key=lambda r: r.doc_id)[:5], docs[:5]))


def test_ids_that_are_null_and_empty_tables(spark):
    table = spark.createDataFrame([(None, "a " * 30)], "doc_id string, text string")
    (row,) = P.find_runs(table).collect()
    assert (row.doc_id, row.start, row.length, row.period, row.exponent_milli) == (None, 0, 30, 1, 30_000)
    assert P.find_runs(table.limit(0), plant=True).collect() == []
