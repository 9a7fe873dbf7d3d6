"""Language-model scoring by prediction by partial matching."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, table, utf8
from .language_id import held_out

#: White-space bytes other than the space occur in no word, so two of them mark a text's start and end.
START, END = b"\n", b"\x0b"
#: Bytes that can follow: all but the white space, the space between words, and the end.
ALPHABET = 256 - 6 + 2
SLICE_BYTES = 16 << 20
#: Texts whose codes are made at once: each byte takes some 100 bytes meanwhile.
BLOCK_BYTES = 1 << 19
GRAMS, WORDS = 0, 1


def _streams(texts: list[bytes], order: int) -> Iterator[tuple[int, int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Texts in blocks: first and last text, their words, the code of each predicted byte with its context, and the text of each."""
    pad, first = START * order, 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK_BYTES):
            size += len(texts[last])
            last += 1
        words = [t.lower().split() for t in texts[first:last]]
        parts = [pad + b" ".join(w) + END for w in words]
        n = np.array([len(p) - order for p in parts])
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        at = np.repeat(np.arange(len(parts)) * order + order, n) + np.arange(n.sum())
        code = np.zeros(len(raw), np.uint64)
        for j in range(order, 0, -1):
            code[j:] |= raw[:-j] << np.uint64(8 * j)
        code |= raw
        yield first, last, words, code[at], np.repeat(np.arange(len(parts)), n)
        first = last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over training texts: bigrams of bytes, words and ends, and the bytes of all texts."""
    for batch in batches:
        train, texts = np.array(batch.column(0).to_pylist(), bool), batch.column(1).to_pylist()
        words: Counter = Counter()
        bigrams = np.zeros(65536, np.int64)
        for first, last, own, code, doc in _streams(texts, 1):
            for w, t in zip(own, train[first:last]):
                if t:
                    words.update(w)
            bigrams += np.bincount((code[train[first:last][doc]] & np.uint64(0xFFFF)).astype(np.int64), minlength=65536)
        words[b""] = int(train.sum())
        some = np.flatnonzero(bigrams)
        kinds = ["word"] * len(words) + ["bigram"] * len(some) + ["bytes"]
        keys = [*words, *(int(c).to_bytes(2, "big") for c in some), b""]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.binary()), pa.array([*words.values(), *bigrams[some].tolist(), sum(map(len, texts))], pa.int64())], ["kind", "key", "n"])


def _context_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context, so that all contexts that end alike are together."""
    c = (code >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _wanted(group: pa.Table, order: int, buckets: int) -> pa.Table:
    """What one slice needs: per bucket its distinct n-grams and words, each with its count in the slice's training texts."""
    which = group.column("slice")[0].as_py()
    train, texts = np.array(group.column("train").to_pylist(), bool), group.column("text").to_pylist()
    codes, counts = [], []
    words: Counter = Counter({b"": int(train.sum())})
    other: set[bytes] = set()
    for first, last, own, code, doc in _streams(texts, order):
        for w, t in zip(own, train[first:last]):
            words.update(w) if t else other.update(w)
        both, n = np.unique(code << np.uint64(1) | train[first:last][doc].astype(np.uint64), return_counts=True)
        code, n = both >> np.uint64(1), np.where(both & np.uint64(1), n, 0)
        codes.append(code)
        counts.append(n.astype(np.uint32))
        while len(codes) > 1 and len(codes[-1]) * 2 > len(codes[-2]):
            codes[-2:], counts[-2:] = ([x] for x in _summed(codes[-2:], counts[-2:]))
    code, n = _summed(codes, counts)
    del codes, counts
    bucket = _context_bucket(code, buckets)
    sort = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[sort], np.arange(buckets + 1))
    rows = [(GRAMS, b, code[i].tobytes(), n[i].astype("<u4").tobytes()) for b, x, y in zip(range(buckets), edges, edges[1:]) if y > x for i in (sort[x:y],)]
    for w in other:
        words.setdefault(w, 0)
    dealt: dict[int, list[bytes]] = {}
    for w in words:
        dealt.setdefault(_word_bucket(w, buckets), []).append(w)
    rows += [(WORDS, b, START.join(ws), np.array([words[w] for w in ws], "<u4").tobytes()) for b, ws in dealt.items()]
    kind, b, keys, counts = zip(*rows)
    return pa.table({"slice": pa.array([which] * len(rows), pa.int64()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(b, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _word_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of sorted arrays, in order, and the sum of the counts of each."""
    if len(codes) == 1:
        return codes[0], counts[0]
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")  # runs in order are merged, not sorted anew
    code, n = code[order], n[order]
    del order
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    return code[first], np.add.reduceat(n, np.flatnonzero(first)) if len(code) else n


class _Level:
    """One order of the trie: per n-gram its count, its context's total and distinct followers, and two log10 probabilities.

    ``free``: of its last byte after its context. ``barred``: the same one order lower, given that the
    byte is none of those seen after this context (symbol exclusion).
    """

    def __init__(self, n: np.ndarray, context: np.ndarray, lower: tuple[np.ndarray, ...]):
        n_low, total_low, kinds_low, free_low, barred_low = lower
        seen = n > 0
        self.n = n
        self.total = np.bincount(context, n)[context]
        self.kinds = np.bincount(context, seen)[context]
        left = total_low - np.bincount(context, n_low * seen)[context]
        left_kinds = kinds_low - self.kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            self.barred = np.where(left_kinds <= 0, barred_low, np.where(n_low > 0, np.log10((n_low - 0.5) / left), np.log10(left_kinds / (2 * left)) + barred_low))
            self.free = np.where(self.total == 0, free_low, np.where(seen, np.log10((n - 0.5) / self.total), np.log10(self.kinds / (2 * self.total)) + self.barred))

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.n[at], self.total[at], self.kinds[at], self.free[at], self.barred[at]


def low_orders(bigrams: np.ndarray) -> _Level:
    """Orders 0 and 1 over all 65,536 bigrams; below order 0 all bytes not seen are alike."""
    follow = bigrams.reshape(256, 256)
    seen = int((follow.sum(axis=0) > 0).sum())
    none = np.zeros(256)
    rest = np.full(256, -math.log10(max(1, ALPHABET - seen)))
    zero = _Level(follow.sum(axis=0), np.zeros(256, np.int64), (none, none, none, np.full(256, -math.log10(ALPHABET)), rest))
    zero.barred = rest
    return _Level(bigrams, np.arange(65536) >> 8, zero.rows(np.arange(65536) & 255))


def log_probabilities(code: np.ndarray, n: np.ndarray, low: _Level, order: int) -> np.ndarray:
    """log10 probability of the last byte of each n-gram by PPM; codes are sorted and hold all n-grams of their contexts.

    Escape by method D: with N occurrences of D kinds after a context, a byte seen n times has
    (n - 1/2) / N and the escape to the next shorter context D / 2N; bytes seen after the longer
    context are excluded there. A context never seen is passed over.
    """
    level, keys = low, None
    for k in range(2, order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own, at = np.unique(code & mask, return_inverse=True)
        below = own & np.uint64((1 << 8 * k) - 1)
        down = below.astype(np.int64) if keys is None else np.searchsorted(keys, below)
        _, context = np.unique(own >> np.uint64(8), return_inverse=True)
        level, keys = _Level(np.bincount(at, n, len(own)), context, level.rows(down)), own
    return level.free[at] if order > 1 else level.free[code.astype(np.int64)]


def _answered(group: pa.Table, order: int, sent: Broadcast) -> pa.Table:
    """Of one bucket: to each slice its n-grams with log10 probabilities and its words with corpus counts."""
    low = low_orders(sent.value)
    slices, kinds = group.column("slice").to_pylist(), group.column("kind").to_pylist()
    keys, counts = group.column("keys").to_pylist(), group.column("counts").to_pylist()
    out = []
    grams = [i for i, k in enumerate(kinds) if k == GRAMS]
    if grams:
        each = [np.frombuffer(keys[i], np.uint64) for i in grams]
        code, n = _summed(each, [np.frombuffer(counts[i], "<u4").astype(np.int64) for i in grams])
        logp = log_probabilities(code, n, low, order)
        out += [(slices[i], GRAMS, keys[i], logp[np.searchsorted(code, own)].tobytes()) for i, own in zip(grams, each)]
    total: Counter = Counter()
    words = [(i, keys[i].split(START)) for i, k in enumerate(kinds) if k == WORDS]
    for i, ws in words:
        for w, c in zip(ws, np.frombuffer(counts[i], "<u4").tolist()):
            total[w] += c
    out += [(slices[i], WORDS, keys[i], np.array([total[w] for w in ws], np.float64).tobytes()) for i, ws in words]
    s, kind, keys, values = zip(*out)
    return pa.table({"slice": pa.array(s, pa.int64()), "kind": pa.array(kind, pa.int32()), "keys": pa.array(keys, pa.binary()), "values": pa.array(values, pa.binary())})


class _Lookup:
    """Places of codes in an array by open addressing: one or two probes instead of a binary search."""

    def __init__(self, codes: np.ndarray):
        self.codes, bits = codes, max(4, len(codes).bit_length() + 1)
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.places = np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(codes), dtype=np.int32)
        slot = self._slot(codes)
        while len(rest):
            free = self.places[slot] < 0
            self.places[slot[free]] = rest[free]
            lost = self.places[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & self.last

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """All codes must be there."""
        slot = self._slot(codes)
        found = self.places[slot]
        rest = np.flatnonzero(self.codes[found] != codes)
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.last
            found[rest] = self.places[slot[rest]]
            rest = rest[self.codes[found[rest]] != codes[rest]]
        return found


def _scored(docs: pa.Table, answers: pa.Table, order: int, total: int, distinct: int) -> pa.Table:
    codes, logps, known = [np.zeros(0, np.uint64)], [np.zeros(0)], {}
    for kind, keys, values in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "values"))):
        if kind == GRAMS:
            codes.append(np.frombuffer(keys, np.uint64))
            logps.append(np.frombuffer(values, np.float64))
        else:
            known.update(zip(keys.split(START), np.frombuffer(values, np.float64).tolist()))
    code = np.concatenate(codes)
    logp, place = np.concatenate(logps), _Lookup(code)
    score, base, n_tokens, n_known = [], [], [], []
    for _, _, words, own, doc in _streams(docs.column("text").to_pylist(), order):
        score.append(np.bincount(doc, logp[place(own)], len(words)))
        n = np.array([len(w) + 1 for w in words])
        c = np.fromiter((known[w] for ws in words for w in (*ws, b"")), np.float64, n.sum())
        of = np.repeat(np.arange(len(words)), n)
        base.append(np.bincount(of, np.log10((c + 1) / (total + distinct + 1)), len(words)))
        n_tokens.append(n)
        n_known.append(np.bincount(of, c > 0, len(words)).astype(np.int64))
    columns = {"n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score}
    empty = {"n_tokens": np.int64, "n_known": np.int64, "base_score": np.float64, "score": np.float64}
    return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), **{k: np.concatenate(v) if v else np.zeros(0, empty[k]) for k, v in columns.items()}})


def ppm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5, buckets: int = 64) -> DataFrame:
    """Scores every text by a PPM byte model and by add-one word counts, both learned from the rows where ``train`` holds.

    Returns ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``. The text scored is
    its words (A-Z lower-cased, split at ``[\\x20\\x09-\\x0D]+``) with one space between, then an end;
    null counts as empty: one token, the end. score is the model's log10 probability of those bytes
    after contexts of up to ``order`` bytes, escape by method D with symbol exclusion (see
    `log_probabilities`); base_score sums log10((c + 1) / (N + V + 1)) over words and end. Without a
    training row all bytes are equally likely. A null ``train`` counts as false; repeated rows count
    and are scored each; other columns are not read.

    No model is gathered in one place. Documents are dealt by a hash to slices of some 16 MB; each
    slice sends its distinct n-grams and words, with their counts, to buckets: n-grams by the last two
    bytes of their context, so a bucket holds whole branches of the trie, words by a hash. There are
    as many buckets as slices, ``buckets`` at least, so both stay of one size. A bucket
    adds up the slices' counts, computes the probabilities, and answers each slice with those it
    asked for. So a frequent word or n-gram moves once per slice, however often it occurs. Only
    bigram counts (65,536 at most), N and V pass through the driver.
    """
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), utf8(text_col).alias("text"))
    counted = cut(rows.select("train", "text").mapInArrow(_counted, "kind string, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    word = F.col("kind") == "word"
    total, distinct, size = counted.agg(F.sum(F.when(word, F.col("n"))), F.count(F.when(word & (F.col("n") > 0), 1)), F.sum(F.when(F.col("kind") == "bytes", F.col("n")))).first()
    total = total or 0
    bigrams = np.zeros(65536, np.int64)
    for r in counted.filter("kind = 'bigram'").select("key", "n").collect():
        bigrams[int.from_bytes(r.key, "big")] = r.n
    sent = spark.sparkContext.broadcast(bigrams)
    slices = max(1, math.ceil((size or 0) / SLICE_BYTES))
    buckets = max(buckets, slices)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)))

    def wanted(group: pa.Table) -> pa.Table:
        return _wanted(group, order, buckets)

    def answered(group: pa.Table) -> pa.Table:
        return _answered(group, order, sent)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right, order, total, distinct)

    asked = dealt.groupBy("slice").applyInArrow(wanted, "slice long, kind int, bucket long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answered, "slice long, kind int, keys binary, values binary")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    found = dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scored, schema)
    return found.select("doc_id", "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm_scores(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
