"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, table

if TYPE_CHECKING:  # workers score without pandas
    import pandas as pd

ASCII_WORD = re.compile("[a-z]+")
#: Scores (words times languages) that a worker keeps before it starts anew, and that it computes at once (characters times languages, about).
CACHED_SCORES, SCORES_AT_ONCE = 600_000, 400_000
#: Texts whose words a worker holds at once.
TEXTS_AT_ONCE = 100


@lru_cache
def _word_pattern() -> re.Pattern:
    """A letter (category L), then letters and marks (M)."""

    def ranges(kinds: str) -> str:
        has = np.array([unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], has, [False]]).astype(np.int8))).reshape(-1, 2)
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, composed (NFC); digits, other numerals and signs are no letters."""
    text = (text or "").lower()
    if text.isascii():
        return ASCII_WORD.findall(text)
    return _word_pattern().findall(unicodedata.normalize("NFC", text))


def _codes(chars: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each position; positions before k - 1 have no meaning."""
    h = np.zeros(len(chars), np.uint64)
    for j in range(k - 1, -1, -1):
        h = (h + np.roll(chars, j)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _chars(words: list[str], order: int) -> np.ndarray:
    """All words, each after order - 1 spaces and before one."""
    pad = " " * (order - 1)
    return np.frombuffer("".join(f"{pad}{w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)


def _found(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


@dataclass
class _Table:
    """Sorted hashes, each with the languages that have it and their values: of hash i those from ``first[i]`` on."""

    codes: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(codes: list[np.ndarray], values: list[np.ndarray]) -> _Table:
        """From the hashes and values of each language."""
        every, lang, value = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes]).astype(np.int32), np.concatenate(values).astype(np.float32)
        order = np.argsort(every, kind="stable")
        own, first = np.unique(every[order], return_index=True)
        return _Table(own, np.append(first, len(every)), lang[order], value[order])

    def cells(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``codes``, language and value of all that is known of them."""
        at, known = _found(self.codes, codes)
        row = np.flatnonzero(known)
        n = (self.first[1:] - self.first[:-1])[at[row]]
        cell = np.repeat(self.first[at[row]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(row, n), self.lang[cell], self.value[cell]


@dataclass
class LanguageModel:
    """Sorted hash arrays: per order the n-grams with their log2 probabilities in the languages that have them, and their contexts with back-off weights."""

    langs: list[str]
    order: int
    grams: list[_Table]
    contexts: list[_Table]
    unknown: float
    mean: np.ndarray
    spread: np.ndarray
    spread_root_n: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each word in each language, and the characters predicted."""
        n = np.array([len(w) + 1 for w in words])
        chars = _chars(words, self.order)
        ends = np.cumsum(n + self.order - 1)
        starts = ends - n
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        total = np.full((len(at), len(self.langs)), self.unknown, np.float32)
        before = np.zeros(len(at), np.uint64)
        for k in range(1, self.order + 1):
            own = _codes(chars, k)
            row, lang, value = self.contexts[k - 1].cells(before)
            total[row, lang] += value
            row, lang, value = self.grams[k - 1].cells(own[at])
            total[row, lang] = value
            before = own[at - 1]
        return np.add.reduceat(total, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0), n

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cross-entropy over which a text of n characters is rejected."""
        return self.mean[lang] + 1.5 * np.maximum(self.spread[lang], self.spread_root_n[lang] / np.sqrt(n))


def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    pad = " " * (order - 1)
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            words.update((lang, w) for w in words_of(text))
        grams: Counter = Counter()
        for (lang, w), n in words.items():
            w = f"{pad}{w} "
            for i in range(len(w) - order + 1):
                grams[lang, w[i : i + order]] += n
        lang, gram = zip(*grams) if grams else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


def _smoothed_one(grams: list[str], counts: np.ndarray, order: int, uniform: float) -> list[tuple[np.ndarray, ...]]:
    """Interpolated Kneser-Ney of one language, from the counts of the highest order; a lower order counts the n-grams that end in it.

    Per order: hashes of the n-grams, their log2 probabilities, hashes of the contexts, log2 back-off weights.
    """
    levels = [(_letters(grams, order), counts.astype(np.float64))]
    for _ in range(order - 1):
        rows, n = np.unique(levels[0][0][:, 1:], axis=0, return_counts=True)
        levels.insert(0, (rows, n.astype(np.float64)))
    code = lambda part: _codes(part.ravel(), part.shape[1])[part.shape[1] - 1 :: part.shape[1]] if part.shape[1] else np.zeros(len(part), np.uint64)
    out, lower_codes, lower_p = [], None, None
    for rows, n in levels:
        codes, at = np.unique(code(rows), return_inverse=True)
        c = np.bincount(at, n)
        rows = rows[np.unique(at, return_index=True)[1]]
        contexts, x = np.unique(code(rows[:, :-1]), return_inverse=True)
        below = np.full(len(codes), uniform) if lower_codes is None else lower_p[np.searchsorted(lower_codes, code(rows[:, 1:]))]
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, types = np.bincount(x, c), np.bincount(x)
        weight = d * types / total
        p = (c - d) / total[x] + weight[x] * below
        out.append((codes, np.log2(p), contexts, np.log2(weight)))
        lower_codes, lower_p = codes, p
    return out


def _letters(grams: list[str], order: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, order)


def _smoothed(counts: pd.DataFrame, langs: list[str], order: int) -> tuple[list[_Table], list[_Table], float]:
    uniform = 1 / (len(np.unique(_letters(counts["gram"].tolist(), order))) + 1)
    own = dict(iter(counts.groupby("lang")))
    each = [_smoothed_one(own[x]["gram"].tolist(), own[x]["n"].to_numpy(), order, uniform) for x in langs]
    grams = [_Table.of([m[k][0] for m in each], [m[k][1] for m in each]) for k in range(order)]
    contexts = [_Table.of([m[k][2] for m in each], [m[k][3] for m in each]) for k in range(order)]
    return grams, contexts, float(np.log2(uniform))


def _scores(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch the cross-entropy in each language (bits a character) and the characters of each text."""
    model: LanguageModel = sent.value
    index: dict[str, int] = {}
    known, size = np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)
    for whole in batches:
        for first in range(0, whole.num_rows, TEXTS_AT_ONCE):
            batch = whole.slice(first, TEXTS_AT_ONCE)
            part = [words_of(t) for t in batch.column(1).to_pylist()]
            new = list({w for words in part for w in words if w not in index})
            if (len(index) + len(new)) * len(model.langs) > CACHED_SCORES:
                index, known, size = {}, known[:0], size[:0]
                new = list({w for words in part for w in words})
            step = max(1000, SCORES_AT_ONCE // (8 * len(model.langs)))
            for at in range(0, len(new), step):
                scores, n = model.word_scores(new[at : at + step])
                known, size = np.concatenate([known, scores]), np.concatenate([size, n])
            index.update(zip(new, range(len(index), len(index) + len(new))))
            lengths = np.array([len(words) for words in part])
            at = np.fromiter((index[w] for words in part for w in words), np.int64, lengths.sum())
            doc = np.repeat(np.arange(len(part)), lengths)
            n = np.bincount(doc, size[at], len(part))
            bits = np.column_stack([np.bincount(doc, known[at, i], len(part)) for i in range(len(model.langs))])
            yield batch, -bits / np.maximum(n, 1)[:, None], n


def _calibration(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch, entropy, n in _scores(batches, sent):
        own = np.array([sent.value.langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(entropy[np.arange(len(own)), own])], ["lang", "n", "entropy"])


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 3000, order: int = 4, reject_quantile: float = 0.999) -> LanguageModel | None:
    """Character models of all non-null languages in ``training``; None where there is none.

    The fit is on a bounded sample: the documents whose id and text hash lowest, ``docs_per_lang`` of each
    language in expectation; so the model's size is bounded by that parameter and the number of
    languages, not by the table. It is broadcast, as is the number of rows of each language.
    N-grams are counted in Spark and only counts of distinct ones reach the driver. Rejection is
    calibrated on the sample: by how much, at the ``reject_quantile``, a text's cross-entropy in its
    own language exceeds the mean, overall and in units of 1 / sqrt(characters).
    """
    rows = bounded_batches(training).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("all"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text"), F.lit(7)), F.lit(1 << 40)) / (1 << 40)
    sample = cut(rows.join(F.broadcast(counts), "lang").filter(draw * F.col("all") < docs_per_lang).select("lang", "text"), "sample")
    grams = sample.mapInArrow(partial(_grams, order=order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return None
    langs = sorted(grams["lang"].unique())
    zero = np.zeros(len(langs))
    model = LanguageModel(langs, order, *_smoothed(grams, langs, order), zero, zero, zero)
    sent = training.sparkSession.sparkContext.broadcast(model)
    seen = sample.filter(F.col("lang").isin(langs)).mapInArrow(partial(_calibration, sent=sent), "lang long, n double, entropy double").filter("n > 0").toPandas()
    mean, spread, rooted = (np.zeros(len(langs)) for _ in range(3))
    for i, own in seen.groupby("lang"):
        over = own["entropy"] - np.average(own["entropy"], weights=own["n"])
        mean[i] = np.average(own["entropy"], weights=own["n"])
        spread[i], rooted[i] = np.quantile(over[own["n"] >= own["n"].median()], reject_quantile), np.quantile(over * np.sqrt(own["n"]), reject_quantile)
    model.mean, model.spread, model.spread_root_n = mean, spread.clip(0.25), rooted.clip(5)
    return model


def _identified(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    model: LanguageModel = sent.value
    names = np.array([*model.langs, "und"], object)
    for batch, entropy, n in _scores(batches, sent):
        best = entropy.argmin(axis=1)
        least = entropy.min(axis=1)
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(-(entropy - least[:, None]) * np.minimum(n, 64)[:, None]).sum(axis=1)
        none = n == 0
        over = least > model.limit(best, np.maximum(n, 1))
        score = np.where(none, 0, np.where(over, score / 2, score))
        columns = [batch.column(0), pa.array(names[np.where(none, len(model.langs), best)], pa.string()), pa.array(score), pa.array(np.where(none, np.nan, least), from_pandas=True), pa.array(none | over)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for each row, from the text alone.

    Texts are lower-cased and their words (runs of letters) scored one by one, with the models'
    n-grams inside word bounds; the language of the lowest cross-entropy in bits a character wins,
    the first by name on ties. score is its share among the languages over at most 64 characters of
    evidence, halved where the text is rejected: its cross-entropy is over the calibrated limit. A
    null text and one without a letter is ``und`` with score 0, rejected. Without a model all are.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_identified, sent=sent), schema)


def _accepted(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    model: LanguageModel = sent.value

    def lettered() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns[:-1], batch.schema.names[:-1]), batch.column(batch.num_columns - 1)], ["row", "text"])

    for batch, entropy, n in _scores(lettered(), sent):
        ok = (n > 0) & (entropy.min(axis=1) <= model.limit(entropy.argmin(axis=1), np.maximum(n, 1)))
        yield pa.RecordBatch.from_struct_array(batch.column(0).filter(pa.array(ok)))


def accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that `identify` doesn't reject; none without a model."""
    if model is None:
        return docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(docs).select("*", F.col(text_col).cast("string").alias("__text")).mapInArrow(partial(_accepted, sent=sent), docs.schema)


def held_out(modulus: int, rest: int):
    """Whether crc32 of doc_id as text leaves ``rest`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(4, 2)))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
