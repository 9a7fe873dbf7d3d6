import random
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LANGS = {"aa": ["th", "ing", "er", "on", "and", "be"], "bb": ["der", "sch", "ung", "ein", "ü", "ge"]}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    both = len(a & b)
    return both / (len(a) + len(b) - both) >= 0.8


def holds(t, item):
    w, v = words(t), words(item)
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    g = grams(v)
    for s in range(max(1, len(w) - len(v) + 1)):
        h = grams(w[s : s + len(v)])
        both = sum((g & h).values())
        if both / max(1, sum(g.values()) + sum(h.values()) - both) >= 0.8:
            return True
    return False


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    text = lambda lang, n: " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(1, 4))) for _ in range(n))
    bench = [(i, text("aa", 30)) for i in range(5)]
    rows = [(i, text(lang, rng.randrange(20, 400)), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(200 + i, re.sub(" ", "\n ", rows[i][1]), "aa", "s", 1) for i in range(8)]
    rows += [(300 + i, rows[i][1] + " th", "aa", "s", 1) for i in range(20, 40)]
    rows += [(400 + i, f"{text('aa', 50)} {bench[i][1].upper()} {text('aa', 50)}", "aa", "s", 1) for i in range(5)]
    rows += [(500, None, "aa", "s", 0), (501, "", None, None, None), (502, "123 !", "aa", "s", 5), (503, "zqx vvkk jjq " * 60, None, "s", 1), (7, rows[7][1], "bb", "s", 1), (None, text("bb", 90), None, None, 1), (None, text("bb", 90), "bb", None, 1)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (2**63 if r.doc_id is None else r.doc_id, r.text or "")
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    kept = one.collect()
    assert {r[0] for r in rows} - {r.doc_id for r in kept} == {500, 501, 502, 503} and len(kept) == len(rows) - 4

    two = stages["exact_dedup"](spark, one, str(tmp_path))
    least = {}
    for r in sorted(kept, key=key):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), key(r))
    assert sorted(map(key, two.collect())) == sorted(least.values())

    three = stages["simhash_dedup"](spark, two, str(tmp_path)).collect()
    left = sorted(two.collect(), key=key)
    sets = [grams(r.text) for r in left]
    root = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    assert sorted(map(key, three)) == sorted(key(left[i]) for i in set(root))
    assert not set(range(300 + 20, 300 + 40)) & {r.doc_id for r in three}  # the planted near copies

    four = stages["decontamination"](spark, spark.createDataFrame(three, docs.schema), str(tmp_path)).collect()
    assert sorted(map(key, four)) == sorted(key(r) for r in three if not any(holds(r.text, t) for _, t in bench))
    assert not {400, 401, 402, 403, 404} & {r.doc_id for r in four}

    five = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == Counter(r.doc_id for r in four)
    held = Counter()
    for r in five:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and len(held) <= -(-sum(held.values()) // 2048) + 1


def test_near_copies_by_simhash_and_by_sets(spark):
    """A pair only SimHash links (3 bits, sets less than 0.8 alike), one only the sets link, and the two joined at one text."""
    from cladeframe.llm.simhash_dedup import simhash

    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    apart = lambda x, y: (simhash(x.encode()) ^ simhash(y.encode())).bit_count()
    # one passage many times: it decides the fingerprint, while the sets are mostly of the ends
    core, ends = " ".join(rng.choices(vocabulary, k=60)), [" ".join(rng.choices(vocabulary, k=30)) for _ in range(40)]
    texts = [" ".join([core] * 40 + [e]) for e in ends]
    one, two = next((x, y) for x in texts for y in texts if x != y and apart(x, y) <= 3)
    assert not alike(grams(one), grams(two))
    base = rng.choices(vocabulary, k=300)
    three, four = next((" ".join(base), y) for at in range(20, 280) for y in [" ".join([*base[:at], "zz", "yy", *base[at + 2 :]])] if apart(" ".join(base), y) > 3)
    assert alike(grams(three), grams(four))
    lone = " ".join(rng.choices(vocabulary, k=200))
    docs = spark.createDataFrame([(5, one), (2, two), (7, three), (9, four), (3, lone), (8, one + " zz")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [2, 3, 7]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
