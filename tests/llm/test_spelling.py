"""Spelling variants against pairwise edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest

from cladeframe.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, times=5):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = [n, best if best and counts[best] >= times * n else None, len(others)]
    for w, found in out.items():
        at = w
        while out[at][1]:
            at = out[at][1]
        out[w] = (found[0], found[1], found[1] and counts[found[1]], at, found[2])
    return out


def got(df):
    return {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in df.collect()}


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    found = {"".join(rng.choices("abcé", k=rng.randint(6, 8))): rng.choice([5, 6, 30, 160, 900, 5000]) for _ in range(250)}
    for w in list(found)[:60]:  # neighbours of all kinds, at the ends too
        i = rng.randrange(len(w))
        found |= {w[:i] + "x" + w[i:]: 7, w[:i] + w[i + 1 :] + "y": 26, "z" + w: 5, w + "z": 130, w[:-1] + "É": 26}
    return {w: n for w, n in found.items() if len(w) >= 6} | {"aaaaaa": 4000, "aaaaaaa": 800, "aaaaaaaa": 160, "aaaaaaaaa": 32, "aaaaaaaaaa": 6, "abcabc": 9, "abcacb": 9}


@pytest.mark.parametrize("group", [200, 3])
def test_variants(spark, words, group):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = got(S.spelling_variants(table, group=group))
    assert found == expected(words)
    assert found["aaaaaaaaaa"][3] == "aaaaaa"


def test_near_words_share_a_signature():
    rng = random.Random(6)
    for _ in range(300):
        a = "".join(rng.choices("abcdeé", k=rng.randint(2, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + "q" + a[i + 1 :], a[:i] + rng.choice("abz") + a[i:]])
        a, b = sorted((a, b), key=len)
        for steps in range(5):
            one, two = ({(k[0], k[1]) for k in S._keys(w, steps)} for w in (a, b))
            if len(a) == len(b):
                assert a == b or {k for k, s in one if s == 0} & {k for k, s in two if s == 0}
            else:
                assert {k for k, s in one if s == 1} & {k for k, s in two if s == 2}


def test_ties_go_to_the_first_word(spark):
    table = spark.createDataFrame([("bananas", 5), ("cananas", 50), ("aananas", 50), ("éananas", 50)], "word string, n long")
    assert got(S.spelling_variants(table))["bananas"] == (5, "aananas", 50, "aananas", 3)


def test_empty(spark):
    table = spark.createDataFrame([], "word string, n long")
    assert S.spelling_variants(table).collect() == []


def test_counts_with_typos(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["Straße", "STRASSE", "été-Étéà", "Ÿber×÷a", "naïve’s", "abcdefg", "Abcdef٣x"], k=rng.randint(0, 40))), 1) for i in range(200)] + [(None, "abcdefg abcdefg", 2), (7, None, 3), (8, "", 4)]
    docs += [docs[0]] * 30 + [(9, "longer" * 5000, 1)] * 5
    want = Counter()
    for i, t, _ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{low}".encode())
            at = h % len(low)
            want[low[:at] + low[at + 1 :] if h % 19 == 0 else low] += 1
    table = spark.createDataFrame(docs, "doc_id long, text string, n int")
    assert {r.word: r.n for r in S.count_words(table, typo_one_in=19).collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert sum(r.n for r in S.count_words(table, least_letters=1, least_count=1).collect()) == sum(want.values())
