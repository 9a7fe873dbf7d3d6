import random
import re

import pytest

from cladeframe.llm.jaccard_dedup import jaccard_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = {i: i for i, _ in rows}
    for x, (a, _) in enumerate(rows):
        for y, (b, _) in enumerate(rows[:x]):
            both = len(sets[x] & sets[y])
            if both / (len(sets[x]) + len(sets[y]) - both) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def corpus(rng):
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [text(rng.randrange(1, 300)) for _ in range(60)]
    shared = text(40)
    for _ in range(80):  # copies around the bound: some words changed, at places far apart or at one end
        w = rng.choice(rows[:60]).split()
        for _ in range(rng.randrange(1, max(2, len(w) // 30))):
            w[rng.randrange(len(w))] = "new"
        rows.append(" ".join(w[rng.randrange(0, max(1, len(w) // 12)) :]))
    rows += [f"{shared} {text(rng.randrange(5, 60))}" for _ in range(40)]
    hot = text(100)
    rows += [re.sub(r"^(\S+)", f"x{i}", hot) if i % 2 else f"{hot} {text(i // 4)}" for i in range(60)]
    rows += [None, "", " ", "A b", "a  B", "a b c d e", "a b c d e a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_against_brute_force(spark):
    rows = corpus(random.Random(8))
    got = jaccard_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert len(set(want.values())) < len(rows) - 100


def test_pipeline_stage_drops_copies_that_differ_in_more_than_three_bits(spark):
    rng = random.Random(2)
    rows = []
    for i in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(i, " ".join(w), "aa", "s", 1), (100 + i, " ".join(w[:90] + ["x", "y"] + w[90:] + ["z"] * 9), "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(30))


def test_long_near_misses_do_not_become_rows(spark):
    """400 texts of 3,500 words of which each two are 0.75 alike, and two that are 0.86 alike to all of a few."""
    from cladeframe.llm import common

    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3500)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(3500), 54):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    close = rows[7][1].split()
    close[100:110] = ["changed"] * 10
    rows.append((400, " ".join(close)))
    common.remove_tables(spark)
    got = {r.doc_id: r.component_id for r in jaccard_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    pairs = sum(spark.read.parquet(p).count() for p in common._written[spark.sparkContext.applicationId] if "_pairs-" in p)
    sets = {i: grams(rows[i][1]) for i in (0, 1, 2)}
    assert all(0.7 < len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.78 for a, b in ((0, 1), (1, 2)))
    assert got == {i: i for i in range(400)} | {400: 7} and pairs < 2000
