"""Every opN query over small tables: its columns and what its contract fixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cladeframe.llm import common, entries
from cladeframe.llm import language_id as L
from cladeframe.llm import quality as Q

QUERIES = entries.queries()
LETTERS = {"aa": "th ing er on and be to".split(), "bb": "der sch ung ein ü ge ß".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("sf")
    items = [(i, prose(rng, "aa", 30)) for i in range(4)]
    docs = [(i, prose(rng, lang, rng.randrange(30, 200)), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 90)]
    docs += [(200 + i, f"{prose(rng, 'aa', 20)} {t} {prose(rng, 'aa', 20)}", "aa", "s", 1) for i, t in items]
    docs += [(300 + i, docs[i][1], docs[i][2], "s", 1) for i in range(6)]
    docs += [(400, None, "aa", "s", 0), (401, "", None, "s", 0), (402, "½ ² ① 7 !", "aa", "s", 9), (403, "été été", "aa", "s", 9)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (items, "item_id long, text string"),
        "labels": ([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200), (3, "http://c", "small"), (4, "http://d", "small"), (5, None, None)], "page_id long, url string, html string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), docs


def rows(spark, sf, number):
    (name,) = [q for q in QUERIES if q.startswith(f"op{number}_")]
    return QUERIES[name](spark, sf[0]).collect()


def held(doc, modulus, rest):
    return zlib.crc32(str(doc).encode()) % modulus == rest


def test_simhash(spark, sf):
    got = {r.doc_id: r for r in rows(spark, sf, 1)}
    assert len(got) == len(sf[1]) and all(len(r.fingerprint) == 16 and set(r.fingerprint) <= set("0123456789abcdef") for r in got.values())
    assert got[400].fingerprint == "0" * 16 and got[401].component_id == 400 and got[303].component_id == 3


def test_warc(spark, sf):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows(spark, sf, 2)}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {1: (1200, sha("x" * 1200), "revisit", 2), 2: (1200, sha("x" * 1200), "response", None), 3: (5, sha("small"), "response", None), 4: (5, sha("small"), "response", None), 5: (0, sha(""), "response", None)}


def test_packing(spark, sf):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in rows(spark, sf, 3)}
    for i, t, *_ in sf[1]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].piece, got[i].start, got[i].length, got[i].ids_crc32) == (0, 0, len(ids), zlib.crc32(ids.tobytes()))


def test_language_model(spark, sf):
    got = {r.doc_id: r for r in rows(spark, sf, 4)}
    split = {i: [w for w in (t or "").encode().lower().split()] for i, t, *_ in sf[1]}
    train = {i for i in split if not held(i, 7, 2)}
    counts = {}
    for i in train:
        for w in (*split[i], None):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for i, r in got.items():
        base = sum(np.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in (*split[i], None))
        assert r.held_out == held(i, 7, 2) and r.n_tokens == len(split[i]) + 1 and r.train_tokens == total
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_suffixes(spark, sf):
    got = {r.doc_id: r for r in rows(spark, sf, 5)}
    data = {i: (t or "").encode() for i, t, *_ in sf[1]}
    seen = {}
    for t in data.values():
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    for i, t in data.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    assert got[303].n_removed == got[303].n_bytes > 200


def test_language(spark, sf):
    got = {r.doc_id: r for r in rows(spark, sf, 7)}
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert [got[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and got[403].lang_pred != "und"
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in sf[1][:180]) > 175


def test_exact(spark, sf):
    got = {r.doc_id: r for r in rows(spark, sf, 8)}
    assert (got[303].keep_id, got[303].group_size, got[303].kept, got[3].kept) == (3, 2, False, True)
    assert got[401].keep_id == 400 and got[400].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_contaminated(spark, sf):
    assert {r.doc_id for r in rows(spark, sf, 9)} == {200, 201, 202, 203}


def test_quality(spark, sf):
    got = rows(spark, sf, 10)
    assert len(got) == len(sf[1])
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_rules_compile_to_columns(spark):
    """The compiled score against rules evaluated one by one."""
    rules = ((1.5, (("letters", "<=", 0.6),)), (-2.0, (("letters", ">", 0.2), ("length", "<=", 3.0))), (0.25, (("digits", ">", 0.0), ("distinct_words", ">", 0.5), ("word_length", "<=", 9.0))))
    model = Q.RuleModel(-0.5, rules)
    texts = ["", None, "abc def", "12 12 12 12", "a1 b2 c3 d4!", "longer words here and there " * 3, "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = {r.doc_id: r for r in df.select("doc_id", *(c.cast("double").alias(k) for k, c in Q.statistics("text").items())).collect()}
    for r in Q.score(df, model).collect():
        s = stats[r.doc_id]
        total = -0.5 + sum(w for w, rule in rules if all(s[k] <= b if op == "<=" else s[k] > b for k, op, b in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_identify_against_the_definition(spark):
    """Cross-entropy of each text in each language, from plain dictionaries of order 3."""
    rng = random.Random(3)
    train = [(i, prose(rng, lang, 12), lang) for i, lang in enumerate(["aa", "bb"] * 15)]
    model = L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), order=3)
    counts = {lang: [{}, {}, {}] for lang in LETTERS}
    for _, t, lang in train:
        for w in L.words_of(t):
            w = f"  {w} "
            for i in range(len(w) - 2):
                counts[lang][2][w[i : i + 3]] = counts[lang][2].get(w[i : i + 3], 0) + 1
    for c in counts.values():
        for k in (2, 1):
            for g in c[k]:
                c[k - 1][g[1:]] = c[k - 1].get(g[1:], 0) + 1
    alphabet = {x for c in counts.values() for g in c[2] for x in g}

    def p(c, history, ch):
        if len(history) == 3:
            raise ValueError
        own = {g: v for g, v in c[len(history)].items() if g[:-1] == history}
        low = p(c, history[1:], ch) if history else 1 / (len(alphabet) + 1)
        values = list(c[len(history)].values())
        once, twice = values.count(1), values.count(2)
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(own.values())
        return max(own.get(history + ch, 0) - d, 0) / total + d * len(own) / total * low if own else low

    texts = [prose(rng, "aa", 3), prose(rng, "bb", 3), "Qüß then", "zzz"]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        entropy = {}
        for lang, c in counts.items():
            bits, n = 0.0, 0
            for w in L.words_of(t):
                w = f"  {w} "
                for k in range(2, len(w)):
                    bits, n = bits - np.log2(p(c, w[k - 2 : k], w[k])), n + 1
            entropy[lang] = bits / n
        assert got[i].lang_pred == min(entropy, key=lambda x: (entropy[x], x)) and got[i].cross_entropy == pytest.approx(min(entropy.values()), abs=1e-4)


def test_written_tables_are_removed(spark, tmp_path):
    common.remove_tables(spark)
    table = common.cut(spark.range(5), "removed")
    assert table.count() == 5 and common.remove_tables(spark) == 1
    import os

    assert not [f for f in os.listdir(common.shared_dir(spark)) if f.startswith("cladeframe-removed")]


def test_token_counts(spark, sf):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, sf, 11)}
    assert got == {i: (len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in sf[1]}


def test_spelling(spark, sf):
    got = {r.word: r for r in rows(spark, sf, 12)}
    assert got and all(len(w) >= 6 and r.n >= 5 and (r.form is None) == (r.form_n is None) and (r.form is not None or r.root == w) for w, r in got.items())


def test_runs(spark, sf):
    got = {r.doc_id: r for r in rows(spark, sf, 13)}
    assert len(got) == len(sf[1]) and all((r.n_runs == 0) == (r.start is None) and len(r.collapsed_sha256) == 64 for r in got.values())
