"""Token counts against the tokenizers themselves."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from cladeframe.llm import token_counts as C  # noqa: E402

ODD = ["<|endoftext|>", "<|startoftext|>x", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|end\x1coftext|>", "'tis", "don't", "WE'LL,", "\"'s", "it's'", "x1y22", "½²①", "İstanbul", "ΣΑΣ", "Straße", "été", "́a", "​ z", " ", "한국어", "日本", "a\x0bb\x0cc\rd\x85e", "n_a-b", "…", "🙂🙂", "ﬁ", "ǅ", "Ä'S", "\x00", "x" * 300, "'", "''re", "()[]{}", "C++/Rust?!"]


def texts(seed, n):
    rng = random.Random(seed)
    plain = ["the", "The", "quick", "brown,", "(fox)", "end.", "été", "Über", "x_y"] + ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(300)]
    for _ in range(n):
        words = rng.choices(plain, k=rng.randint(0, 60)) + rng.choices(ODD, k=rng.randint(0, 5))
        rng.shuffle(words)
        yield rng.choice([" ", "  ", "\n", "\t \n"]).join(words)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("frequent", [1 << 19, 50])
def test_counts(spark, monkeypatch, name, frequent):
    monkeypatch.setattr(C, "FREQUENT", frequent)
    path = public_tokenizers.path(name)
    tok = tokenizers.Tokenizer.from_file(path)
    docs = [(i, t, "x", 1) for i, t in enumerate(texts(1, 250))] + [(1000, None, None, 0), (1001, "", "", 0), (1002, "word " * 40_000, "", 0), (1003, "ab" * 20_000, "", 0)]
    docs += [(None, "of no id", "", 0)] * 2 + [docs[3]] * 50 + [(2000 + i, t, "", 0) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(docs, "doc_id long, text string, key string, n_bytes int").repartition(5)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(table, path).collect()) == want


def test_parts_are_split_as_whole_texts():
    split = C.PreTokens(public_tokenizers.path("word_bpe_49k.json"))
    assert split.by_parts and not C.PreTokens(public_tokenizers.path("byte_bpe_50k.json")).by_parts
    for t in texts(2, 200):
        added, whole = split._split(t)
        parts = [(*split.of(p), n) for p, n in C.Counter(split.cut(t)).items()]
        assert added == sum(a * n for a, _, n in parts)
        assert sorted(whole) == sorted(w for _, found, n in parts for w in found * n)


def test_simple_parts_as_the_library_splits_them():
    split = C.PreTokens(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    for c in letters:
        assert split.part(c) == (0, tuple(split._split(c)[1]))
    for _ in range(3000):
        part = "".join(rng.choices(letters, k=rng.randint(1, 8))) if rng.random() < 0.5 else "".join(rng.choices("'sStTrReEvVmMlLdD1éÉ.", k=rng.randint(1, 8)))
        assert C.SIMPLE.fullmatch(part) and split.part(part) == (0, tuple(split._split(part)[1]))


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(table, public_tokenizers.path("word_bpe_49k.json")).collect() == []
