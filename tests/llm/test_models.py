import random

import numpy as np
import pytest

from cladeframe.llm import language_id as L
from cladeframe.llm import quality as Q

SYLLABLES = {"aa": ["th", "ing", "er", "on", "and"], "bb": ["der", "sch", "ung", "ein", "ü"], "cc": ["que", "eau", "é", "oi", "tion"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    train = [(i, text(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 80)] + [(500, "no label", None), (501, None, "aa"), (None, text(rng, "aa"), "aa")]
    model = L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    odd = [(900, None), (901, ""), (902, "12 !?"), (903, "zxqj wvkp qqqq xxzz jjkk vvww" * 20), (903, "zxqj wvkp qqqq xxzz jjkk vvww" * 20), (904, "th" * 200_000), (None, "sch")]
    df = spark.createDataFrame([(*r[:2], "bb") for r in rows] + [(*r, None) for r in odd], "doc_id long, text string, lang_pred string")
    got = L.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[i].lang_pred == lang and not by[i].rejected and by[i].score > 0.9 for i, _, lang in rows)
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert by[903].rejected and by[904].lang_pred == "aa" and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert L.identify(df.limit(0), model).count() == 0
    none = L.fit(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert none is None and {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}


def test_kneser_ney_sums_to_one_and_matches_the_definition():
    import pandas as pd

    words = ["abab", "abc", "cab", "bca"]
    grams = {}
    for w in words:
        w = f" {w} "
        for i in range(len(w) - 1):
            grams[w[i : i + 2]] = grams.get(w[i : i + 2], 0) + 1
    counts = pd.DataFrame({"lang": "x", "gram": list(grams), "n": list(grams.values())})
    parts = L._smoothed(counts, ["x"], 2)
    model = L.LanguageModel(["x"], 2, *parts, *[np.zeros(1)] * 3)
    alphabet = {c for g in grams for c in g}
    follow = {c: len({a for a, b in grams if b == c}) for c in alphabet}
    total, types = sum(follow.values()), sum(v > 0 for v in follow.values())
    disc = lambda values: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(values.count(1), values.count(2))
    d1, d2 = disc([v for v in follow.values() if v]), disc(list(grams.values()))

    def p(c, h):
        low = max(follow.get(c, 0) - d1, 0) / total + d1 * types / total / (len(alphabet) + 1)
        n = [v for g, v in grams.items() if g[0] == h]
        return max(grams.get(h + c, 0) - d2, 0) / sum(n) + d2 * len(n) / sum(n) * low if n else low

    for w in ["abc", "bbb", "azc", "cb"]:
        want = sum(np.log2(p(c, h)) for h, c in zip(" " + w, w + " "))
        assert model.word_scores([w])[0][0, 0] == pytest.approx(want, abs=1e-4)


def test_quality_rules(spark):
    rng = random.Random(2)
    good = lambda: text(rng, "aa", 60).capitalize() + "."
    bad = lambda: rng.choice([" ".join(["SPAM!!"] * 40), "| x | y |\n" * 30, "one " * 80])
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, "x" * 300_000, ""), (None, "a", "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 300] + [(5000, 1), (None, 0), (1, None), (2, 7)], "doc_id long, quality int")
    model = Q.fit(docs, labels, trees=8)
    assert model.rules
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == q for i, _, q in rows if i >= 300]) > 0.97
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels.limit(0))).collect()} == {0.5}
    one = {r.score for r in Q.score(docs, Q.fit(docs, labels.filter("quality = 1"))).collect()}
    assert len(one) == 1 and one.pop() > 0.9
    assert Q.score(docs.limit(0), model).count() == 0


def test_paths_of_a_printed_tree():
    printed = """Forest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert Q._paths(printed, ["a", "b"]) == {(("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", "<=", 0.5), ("b", ">", 2.0)), (("a", ">", 0.5),)}


def test_fit_ignores_other_columns(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    plain = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clash = L.fit(spark.createDataFrame([(*r, "x", 1, "g", 2) for r in rows], "doc_id long, text string, lang string, id string, all int, gram string, n int"))
    assert plain.langs == clash.langs and (plain.grams[3].value == clash.grams[3].value).all()


def test_only_letters_make_words():
    assert L.words_of("½ ² ① 7 _ -") == [] and L.words_of(None) == []
    assert L.words_of("Abc1def été हिन्दी") == ["abc", "def", "été", "हिन्दी"]


def test_rejection_takes_other_languages_and_junk(spark):
    rng = random.Random(4)
    model = L.fit(spark.createDataFrame([(i, text(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 100)], "doc_id long, text string, lang string"))
    known = [(i, text(rng, lang, 60)) for i, lang in enumerate(["aa", "bb"] * 50)]
    other = [(1000 + i, text(rng, "cc", 60)) for i in range(20)] + [(2000 + i, " ".join("".join(rng.choices("qxzjkvw", k=7)) for _ in range(40))) for i in range(20)]
    got = {r.doc_id: r.rejected for r in L.identify(spark.createDataFrame(known + other, "doc_id long, text string"), model).collect()}
    assert not any(got[i] for i, _ in known) and all(got[i] for i, _ in other)


def test_language_models_where_all_rows_have_one_id_or_none(spark):
    rng = random.Random(5)
    words = {"aa": "th ing er on and be to".split(), "bb": "der sch ung ein ge zu".split()}
    text = lambda lang: " ".join("".join(rng.choices(words[lang], k=3)) for _ in range(40))
    for same in (7, None):
        docs = spark.createDataFrame([(same, text(lang), lang) for lang in ("aa", "bb") for _ in range(300)], "doc_id long, text string, lang string")
        model = L.fit(docs, docs_per_lang=100)
        assert model is not None and model.langs == ["aa", "bb"]
        got = L.identify(docs, model).groupBy("lang_pred").count().collect()
        assert {r.lang_pred: r["count"] for r in got} == {"aa": 300, "bb": 300} and L.accepted(docs, model).count() > 580


def test_scoring_holds_few_texts_at_once_and_no_pandas():
    import subprocess
    import sys
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd
    import pyarrow as pa

    rng = random.Random(2)
    letters = "abcdefghij"
    texts = ["".join(rng.choices(letters + " ", k=2500)) for _ in range(1000)]
    langs = list("vwxyz")
    counts = pd.DataFrame([(lang, a + b + c, 1) for lang in langs for a in letters + " " for b in letters for c in letters + " "], columns=["lang", "gram", "n"])
    model = L.LanguageModel(langs, 3, *L._smoothed(counts, langs, 3), *[np.zeros(5)] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    got = [e for _, e, _ in L._scores(iter([batch]), SimpleNamespace(value=model))]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sum(map(len, got)) == len(texts)
    assert peak < 100, peak
    assert subprocess.run([sys.executable, "-c", "import sys, cladeframe.llm.language_id; sys.exit('pandas' in sys.modules)"]).returncode == 0
