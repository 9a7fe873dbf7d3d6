"""Token counts of documents: each distinct pre-token is counted once and joined to the documents that hold it."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, table
from .packing import default_tokenizer

#: A pre-token is frequent if it makes more than one in so many of all, so there are fewer of these; longer ones never count as frequent.
FREQUENT, FREQUENT_CHARS = 1 << 19, 48
#: Distinct parts of texts that a worker counts or keeps split before it lets go of them.
HELD = 300_000
#: Pre-tokens of a tokenizer whose pattern never crosses white space: contractions, letters, single digits, anything else.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Parts of characters on which this pattern is the one below: printable ASCII, and letters that are one code point in every normal form and case.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SIMPLE_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Such a letter in the alphabet of byte-level tokenizers: bytes that are no printable character of Latin-1 count on from 256.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = dict(zip([*PRINTABLE, *(b for b in range(256) if b not in PRINTABLE)], map(chr, [*PRINTABLE, *range(256, 512)])))
LETTERS = {c: "".join(BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class PreTokens:
    """Splits texts into a tokenizer's pre-tokens, in the tokenizer's own alphabet, and counts the pieces of one.

    Added tokens that stand in a text are taken out first, as the library does by default; each is
    one token. Texts are split at blanks, and each distinct part once, if the tokenizer's own settings say that
    none of its steps looks beyond; others go through its normaliser and pre-tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        if said.get("truncation") or said.get("padding"):
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        added = said.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on what stands beside them can't be counted apart from their text")
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        steps = (said.get("normalizer") or {}).get("normalizers") or []
        splits = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
        plain = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        own = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        after = [{k: s.get(k) for k in ("type", "add_prefix_space", "use_regex")} for s in splits[1:]]
        self.by_parts = own and splits[:1] == [plain] and after == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}] and not any(re.search(r"\s", c) for c in contents)

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))

    def _split(self, text: str) -> tuple[int, list[str]]:
        """How many added tokens stand in the text, and the pre-tokens of the rest."""
        t = self.tokenizer
        segments = self.added.split(text) if self.added else [text]
        out = []
        for s in segments:
            s = t.normalizer.normalize_str(s) if t.normalizer else s
            out += (w for w, _ in t.pre_tokenizer.pre_tokenize_str(s)) if t.pre_tokenizer else [s] * bool(s)
        return len(segments) - 1, out

    def part(self, part: str) -> tuple[int, tuple[str, ...]]:
        """`_split` of a part of a text without blanks."""
        if SIMPLE.fullmatch(part) and not (self.added and self.added.search(part)):
            split = SIMPLE_PATTERN.findall(part.lower())
            return 0, tuple(split if part.isascii() else [w if w.isascii() else w.translate(LETTERS) for w in split])
        return self._part(part)

    def _part(self, part: str) -> tuple[int, tuple[str, ...]]:
        added, split = self._split(part)
        return added, tuple(split)

    def cut(self, text: str) -> list[str]:
        """The parts of the text; for other tokenizers, the text."""
        return text.replace("\n", " ").replace("\t", " ").split(" ") if self.by_parts else [text]

    def of(self, part: str) -> tuple[int, tuple[str, ...]]:
        """Added tokens and pre-tokens of what `cut` has found."""
        return self.part(part) if self.by_parts else self._part(part)


@lru_cache(1)
def _pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _vocabulary(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split, held = _pre_tokens(path), Counter()

    def handed() -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for part, n in held.items():
            for w in split.of(part)[1]:
                found[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pre_token", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(split.cut(text.as_py() or ""))
            if len(held) > HELD or not split.by_parts:
                yield handed()
                held.clear()
    yield handed()


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = _pre_tokens(path).pieces
    for batch in batches:
        yield batch.append_column("pieces", pa.array([pieces(w) for w in batch.column(0).to_pylist()], pa.int64()))


_FOUND = ("row", "doc_id", "n_bytes", "key", "n")


def _frequencies(batches: Iterator[pa.RecordBatch], path: str, sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per document a row with the tokens of its frequent pre-tokens, and one for each other pre-token."""
    split, known = _pre_tokens(path), sent.value
    kept: dict[str, tuple[int, tuple[str, ...]]] = {}

    def looked_up(part: str) -> tuple[int, tuple[str, ...]]:
        """Added tokens and pieces of frequent pre-tokens in a part, and its other pre-tokens."""
        added, found = split.of(part)
        out = added + sum(known.get(w, 0) for w in found), tuple(w for w in found if w not in known)
        if split.by_parts:
            if len(kept) > HELD:
                kept.clear()
            kept[part] = out
        return out

    for batch in batches:
        texts = batch.column(3)
        for first in range(0, len(texts), 100):
            row, doc, size, key, n = [], [], [], [], []
            some = batch.slice(first, 100)
            for i, (at, text) in enumerate(zip(some.column(0).to_pylist(), texts.slice(first, 100))):
                tokens, rest = 0, {}
                for part, times in Counter(split.cut(text.as_py() or "")).items():
                    pieces, others = kept.get(part) or looked_up(part)
                    tokens += pieces * times
                    for w in others:
                        rest[w] = rest.get(w, 0) + times
                k = 1 + len(rest)
                row += [at] * k
                doc += [i, *[None] * (k - 1)]
                size += [i, *[None] * (k - 1)]
                key += [f"d{at}", *("w" + w for w in rest)]
                n += [tokens, *rest.values()]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), some.column(1).take(pa.array(doc, pa.int64())), some.column(2).take(pa.array(size, pa.int64())), pa.array(key, pa.string()), pa.array(n, pa.int64())], list(_FOUND))


def vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """The distinct pre-tokens of all texts, how often each occurs, and its pieces: ``pre_token, n, pieces``."""
    texts = bounded_batches(docs).select(F.col(text_col).cast("string"))
    found = texts.mapInArrow(partial(_vocabulary, path=tokenizer_path), "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return found.mapInArrow(partial(_pieces, path=tokenizer_path), "pre_token string, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of each text without special ones around it: ``doc_id, n_bytes, n_tokens, over_limit``, a row per input row.

    ``tokenizer_path`` is a file of the tokenizers library. The pieces of each distinct pre-token are
    counted once; ids are never made. Documents' pre-token frequencies are joined with these counts
    and summed by row. Pre-tokens of at least one in `FREQUENT` of all occurrences and at most
    `FREQUENT_CHARS` characters are looked up where the text lies (fewer than half a million short
    strings, so the table that is sent has a proven bound), which leaves no hot key for the join.

    A null or empty text has 0 bytes and 0 tokens. Strings of the tokenizer's added tokens in a text
    are one token each, as the library has it by default. Rows are told apart by number, so repeated
    or null ids are counted each; other columns are not read.
    """
    words = cut(vocabulary(docs, tokenizer_path, text_col), "vocabulary")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = (F.col("n") > total / FREQUENT) & (F.length("pre_token") <= FREQUENT_CHARS)
    sent = docs.sparkSession.sparkContext.broadcast({w: k for w, k in words.filter(frequent).select("pre_token", "pieces").collect()})
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])
    rows = bounded_batches(docs).select(F.monotonically_increasing_id(), F.col(id_col), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(partial(_frequencies, path=tokenizer_path, sent=sent), schema)
    rare = words.filter(~frequent).select(F.concat(F.lit("w"), "pre_token").alias("key"), "pieces")
    tokens = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1)))  # a document's own row joins nothing
    counted = found.join(rare, "key", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_tokenizer())
