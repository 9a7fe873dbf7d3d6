"""Benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, table, utf8

#: Windows of a text that are looked up at once.
WINDOWS = 2048
#: Hamming blocks of a fingerprint; the bits by which two of 16 bits may differ are a quarter of the radius.
BLOCKS = 4
#: Bytes of item texts that are sent to the tasks at once.
ITEM_BYTES = 32 << 20
#: Words whose hashes a worker keeps before it starts anew.
CACHED_WORDS = 300_000


def _words(data: bytes) -> list[bytes]:
    return data.lower().split()


def _hashed(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shingled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return _mixed(out)


def _window_simhashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` shingles: a bit is set if over half of the window's hashes have it."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0)])
    ones = total[size:] - total[:-size]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shingles weigh as often as they occur."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@lru_cache
def _flips(most: int) -> np.ndarray:
    """All 16-bit masks of at most ``most`` bits."""
    masks = np.arange(1 << 16, dtype=np.uint16)
    return masks[np.bitwise_count(masks) <= most]


class _Blocks:
    """Multi-index over fingerprints: for each 16-bit block, the fingerprints near each of its values, as a bit set.

    Two fingerprints within ``radius`` differ by at most ``radius // 4`` bits in one of four blocks,
    so a look-up of a window's four blocks gives every fingerprint within the radius.
    """

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        parts = fps.view(np.uint16).reshape(-1, BLOCKS)
        self.near = np.zeros((BLOCKS, 1 << 16, -(-len(fps) // 8)), np.uint8)
        flips = _flips(radius // BLOCKS)
        for i, own in enumerate(parts):
            for b in range(BLOCKS):
                self.near[b, own[b] ^ flips, i >> 3] |= np.uint8(1 << (i & 7))

    def candidates(self, fps: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, fingerprint from ``first`` to before ``last``) that agree nearly enough in a block."""
        parts = fps.view(np.uint16).reshape(-1, BLOCKS)
        cells = slice(first >> 3, -(-last >> 3))
        met = self.near[0, parts[:, 0], cells]
        for b in range(1, BLOCKS):
            met = met | self.near[b, parts[:, b], cells]
        bits = np.unpackbits(met, axis=1, bitorder="little")[:, first & 7 : (first & 7) + last - first]
        w, i = np.nonzero(bits)
        return w, i + first

    def within(self, fps: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these pairs those within the radius, and their distances."""
        w, i = self.candidates(fps, first, last)
        far = np.bitwise_count(fps[w] ^ self.fps[i])
        ok = far <= self.radius
        return w[ok], i[ok], far[ok]


class _Index:
    """A block of benchmark items, ordered by size: their shingles, and a multi-index of their SimHashes."""

    def __init__(self, items: list[tuple[object, bytes]], k: int, radius: int):
        self.known = {}
        self.items: list[tuple[object, int, int, Counter]] = []  # id, words, words per shingle, shingles
        self.sizes: dict[tuple[int, int], tuple[int, int]] = {}  # words per shingle and words: first item, and one past the last
        grams: dict[int, list[np.ndarray]] = defaultdict(list)
        fps = []
        split = ((item, _words(text)) for item, text in items)
        for item, words in sorted((x for x in split if x[1]), key=lambda x: len(x[1])):
            own = min(k, len(words))
            s = _shingled(_hashed(words, self.known), own)
            self.sizes[own, len(words)] = (self.sizes.get((own, len(words)), (len(self.items),))[0], len(self.items) + 1)
            grams[own].append(s)
            fps.append(_window_simhashes(s, len(s))[0])
            self.items.append((item, len(words), own, Counter(s.tolist())))
        self.grams = {k: np.unique(np.concatenate(v)) for k, v in grams.items()}
        self.has = {}
        for own, v in self.grams.items():  # by the top bits: most shingles need no search
            self.has[own] = np.zeros(1 << 20, bool)
            self.has[own][(v >> np.uint64(44)).astype(np.int64)] = True
        self.blocks = _Blocks(np.array(fps, np.uint64), radius)

    def matches(self, data: bytes, least: float) -> Iterator[tuple[object, float, int, int, int]]:
        """Per matching item: its id, similarity, Hamming distance, first word and words of the best window."""
        words = _words(data)
        h = _hashed(words, self.known)
        hits: dict[int, np.ndarray] = {}
        grams: dict[int, np.ndarray] = {}
        for k, known in self.grams.items():
            s = _shingled(h, k)
            at = np.flatnonzero(self.has[k][(s >> np.uint64(44)).astype(np.int64)])
            at = at[known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]]
            if len(at):
                hit = np.zeros(len(s) + 1, np.int64)
                hit[at + 1] = 1
                hits[k], grams[k] = np.cumsum(hit), s
        best: dict[int, tuple[float, int, int]] = {}
        for (k, n), own in self.sizes.items() if hits else ():
            if k not in hits:
                continue
            s, wide = grams[k], min(n - k + 1, len(grams[k]))
            starts = hits[k][wide:] - hits[k][:-wide] >= least * wide
            runs = np.flatnonzero(np.diff(np.concatenate([[False], starts, [False]]).astype(np.int8)))
            for first, last in zip(runs[::2].tolist(), runs[1::2].tolist()):
                for at in range(first, last, WINDOWS):  # a text may be as long as many items together
                    fp = _window_simhashes(s[at : min(at + WINDOWS, last) + wide - 1], wide)
                    for x, y, d in zip(*(v.tolist() for v in self.blocks.within(fp, *own))):
                        sim = similarity(Counter(s[at + x : at + x + wide].tolist()), self.items[y][3])
                        if sim >= least and sim > best.get(y, (0,))[0]:
                            best[y] = (sim, d, at + x)
        for item, (sim, d, at) in sorted(best.items()):
            name, n, _, _ = self.items[item]
            yield name, sim, d, at, min(n, len(words))


def _found(batches: Iterator[pa.RecordBatch], sent: Broadcast, k: int, radius: int, least: float, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    index = _Index(sent.value, k, radius)
    for batch in batches:
        rows = [(i, *m) for i, text in enumerate(batch.column(1).to_pylist()) for m in index.matches(text, least)]
        i, item, sim, far, at, width = zip(*rows) if rows else ((),) * 6
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(item, item_type), pa.array(sim, pa.float64()), pa.array(far, pa.int32()), pa.array(at, pa.int64()), pa.array(width, pa.int64())], ["doc_id", "item_id", "similarity", "distance", "start_word", "n_words"])


def _item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, items_per_block: int) -> Iterator[Broadcast]:
    items = benchmark.select(F.col(item_col).alias("item_id"), utf8(item_text_col).alias("text")).distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / items_per_block), math.ceil((size or 0) / ITEM_BYTES))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in part.collect()])


def _clean(batches: Iterator[pa.RecordBatch], sent: Broadcast, k: int, radius: int, least: float) -> Iterator[pa.RecordBatch]:
    index = _Index(sent.value, k, radius)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        ok = [next(index.matches(t, least), None) is None for t in texts]
        yield batch.select(batch.schema.names[:-1]).filter(pa.array(ok, pa.bool_()))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words_per_shingle: int = 5, least_similarity: float = 0.8, radius: int = 19, items_per_block: int = 2048) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which `contaminated` finds no item."""
    for sent in _item_blocks(benchmark, item_col, item_text_col, items_per_block):
        docs = bounded_batches(docs).select("*", utf8(text_col).alias("__bytes")).mapInArrow(partial(_clean, sent=sent, k=words_per_shingle, radius=radius, least=least_similarity), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words_per_shingle: int = 5, least_similarity: float = 0.8, radius: int = 19, items_per_block: int = 2048) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, similarity, distance, start_word, n_words``.

    Words are lower-cased (A-Z) and split at ``[\\x20\\x09-\\x0D]+``. For each item every window of
    the item's number of words is compared: its SimHash is looked up in a multi-index of four
    16-bit blocks, in which two fingerprints within ``radius`` agree up to ``radius // 4`` bits in
    some block, so none within the radius is missed and of unrelated ones about a seventh is met;
    then the weighted Jaccard similarity of their shingles (weight: occurrences) decides. Only
    windows of which the share ``least_similarity`` of shingles occurs in the benchmark are
    fingerprinted, for no other can be as similar. At a similarity of 0.8 the expected distance is
    10 bits with a deviation of 3, so the default radius lies over three deviations above.

    A row per document row and item, with the best window (the first on ties). Items of fewer words
    than a shingle takes are one shingle; a document shorter than an item is one window. Empty and
    null texts on either side match nothing; null ids are kept as they are.

    The items are taken in blocks of at most about ``items_per_block`` and 32 MB, by a hash of id and text, and
    each block is sent to all tasks, so what is broadcast is bounded; documents do not move.
    """
    source = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for sent in _item_blocks(benchmark, item_col, item_text_col, items_per_block):
        part = source.mapInArrow(partial(_found, sent=sent, k=words_per_shingle, radius=radius, least=least_similarity, item_type=item_type), schema)
        out = part if out is None else out.unionByName(part)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
