"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, spread_join, table, utf8
from .components import connected_components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(data: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``, XXH64 of each shingle.

    A bit is 1 if it is set in over half of the shingle hashes, repeats included. Fewer words than
    a shingle takes: the whole sequence is one shingle; no word: 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, n)
    at = h.view(np.uint8).reshape(n, 8).astype(np.intp) + np.arange(0, 2048, 256)  # little-endian: byte i holds bits 8i..8i+7
    ones = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel(), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([simhash(x, k, seed) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the SimHash of each document as a signed long with the same bits; null text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(partial(_fingerprints, k=words_per_shingle, seed=seed), schema)


@lru_cache
def _masks(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flips of radius 0 and 1, of radius 2 within one half, and the bucket of each by a linear map to ``bits`` bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    near = np.concatenate([np.zeros(1, np.uint64), one])
    far = np.array([one[i] | one[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)], np.uint64)
    return near, far, _bucket(near, bits), _bucket(far, bits)


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    """Linear over xor: bucket(a ^ b) = bucket(a) ^ bucket(b)."""
    columns = np.random.default_rng(64).integers(1, 2**bits, 64) if bits else np.zeros(64, np.int64)
    out = np.zeros(len(x), np.int64)
    for i in range(64):
        out ^= np.where((x >> np.uint64(i)) & np.uint64(1), columns[i], 0)
    return out


def _dealt(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A row (bucket, fingerprint) for each bucket that variants of the fingerprint fall in."""
    _, _, near_b, far_b = _masks(bits)
    odd_b, even_b = np.unique(near_b), np.unique(np.concatenate([near_b, far_b]))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        odd = np.bitwise_count(fp) % 2 == 1
        for part, to in ((fp[odd], odd_b), (fp[~odd], even_b)):
            for at in range(0, len(part), 4096):
                x = part[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array((_bucket(x, bits)[:, None] ^ to).ravel()), pa.array(np.repeat(x, len(to)).view(np.int64))], ["bucket", "fp"])


def _variants(fp: np.ndarray, own: np.ndarray, bucket: int, masks: np.ndarray, masks_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The variants that fall in the bucket, and the fingerprint that each comes from."""
    order = np.argsort(masks_b, kind="stable")
    want = own ^ bucket
    first, last = np.searchsorted(masks_b[order], want), np.searchsorted(masks_b[order], want, "right")
    n = last - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    source = np.repeat(fp, n)
    return source ^ masks[order[at]], source


def _met(group: pa.Table, bits: int, radius: int) -> pa.Table:
    """Links of one bucket: from each fingerprint to the least fingerprint within radius 1 of a variant that both emit."""
    near, far, near_b, far_b = _masks(bits)
    bucket = group.column("bucket")[0].as_py()
    fp = np.unique(group.column("fp").to_numpy()).view(np.uint64)
    own = _bucket(fp, bits)
    v, f = _variants(fp, own, bucket, near, near_b)
    order = np.lexsort((f, v))
    v, f = v[order], f[order]
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    at, hub = v[first], f[first]  # least fingerprint of each variant
    links = [np.stack([f, np.repeat(hub, np.diff(np.append(np.flatnonzero(first), len(v))))])]
    even = np.bitwise_count(fp) % 2 == 0
    for part in range(0, int(even.sum()), 65536):
        x, y = _variants(fp[even][part : part + 65536], own[even][part : part + 65536], bucket, far, far_b)
        if len(at):
            i = np.minimum(np.searchsorted(at, x), len(at) - 1)
            hit = at[i] == x
            links.append(np.stack([y[hit], hub[i[hit]]]))
    a, b = np.concatenate(links, axis=1)
    a, b = a[a != b], b[a != b]
    assert not len(a) or (np.bitwise_count(a ^ b) <= radius).all()
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pa.table({"a": np.ascontiguousarray(pairs[:, 0]).view(np.int64), "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)})


def fingerprint_links(fps: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints at 3 or fewer differing bits, enough to join all that are linked.

    Meet in the middle: fingerprints at distance 1 or 3 differ in the parity of their bits, so it is
    enough that every fingerprint emits the 65 variants within radius 1 and those of even parity
    also the variants at radius 2. Of three differing bits two lie in the same half, so only the
    992 flips within a half are needed. Variants are dealt by a hash that is linear over xor, which
    lets a row (bucket, fingerprint) stand for all variants of the fingerprint in that bucket; they
    are spelled out after the shuffle. In a bucket each variant links its emitters to the least
    emitter within radius 1, which is within 3 of each of them, so links grow with the variants that
    meet and never with the square of a group.

    The number of buckets follows the number of distinct fingerprints, so a bucket stays small;
    64 at least.
    """
    distinct = cut(fps.select(F.col(fp_col).alias("fp")).filter("fp is not null").distinct(), "fps")
    bits = max(6, math.ceil(math.log2(max(1, distinct.count() * 561 / 4e6))))
    dealt = distinct.mapInArrow(partial(_dealt, bits=bits), "bucket long, fp long")

    def met(group: pa.Table) -> pa.Table:
        return _met(group, bits, 3)

    return dealt.groupBy("bucket").applyInArrow(met, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate classes of documents: ``doc_id, fp, component_id``, one row per input row.

    Documents are linked when their SimHashes differ in 3 or fewer of 64 bits; component_id is the
    smallest id reachable, the document's own included. Null and empty texts have fingerprint 0 and
    are linked like any other; rows with a repeated id are linked like different documents; a null
    id is never the smallest unless it is alone. Equal fingerprints are collapsed before any link
    is sought, so copies cost one row each.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words_per_shingle, seed), "fingerprints")
    nodes = cut(connected_components(fingerprint_links(fps)), "components")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    classed = own.join(nodes, own.fp == nodes.node, "left").select("fp", "least", "times", F.coalesce("component", "fp").alias("component"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = cut(classed.join(least, "component").select("fp", "times", "component_id"), "classes")
    return spread_join(fps, classes, ["fp"], "times").select("doc_id", "fp", "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
