"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, spread_join, table, utf8

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_GEAR = np.random.default_rng(8).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, mean: int = 4096, least: int = 1024, most: int = 65536) -> list[int]:
    """Ends of the content-defined chunks of ``data``.

    A gear hash of the last 32 bytes, summed by doubling steps, cuts where its top bits are zero:
    on average each ``mean`` bytes, never before ``least``; a run without a cut is split each
    ``most`` bytes from the last cut.
    """
    n = len(data)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for at in (np.flatnonzero(h < np.uint32(2**32 // mean)) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunks(data: bytes) -> list[bytes]:
    ends = chunk_ends(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes, size: int, key: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size, key=key.to_bytes(4, "big")).digest()


def _occurrences(batches: Iterator[pa.RecordBatch], size: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = list({c for text in batch.column(0).to_pylist() for c in _chunks(SPACE.sub(b" ", text))})
        yield pa.RecordBatch.from_arrays([pa.array([_digest(c, size, key) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])


def _recipes(batches: Iterator[pa.RecordBatch], size: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipe, sha, n = [], [], []
        for text in batch.column(1).to_pylist():
            text = SPACE.sub(b" ", text)
            recipe.append(b"".join(_digest(c, size, key) for c in _chunks(text)))
            sha.append(hashlib.sha256(text).hexdigest())
            n.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string()), pa.array(n, pa.int64())], ["doc_id", "recipe", "text_sha256", "n_bytes"])


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """One row per document: ``doc_id, recipe, text_sha256, n_bytes``.

    The text, with each run of ``[\\x20\\x09-\\x0D]`` as one space, is cut into content-defined
    chunks; the recipe is the ordered list of chunk identifiers, joined. Every chunk's bytes move
    once, after duplicates within a batch and a task are gone, to verify that no identifier stands
    for two chunks; should one do, all are made anew with another key and twice the size. So equal
    recipes mean equal texts, and from then on only recipes move.
    """
    key = 0
    while True:
        pairs = bounded_batches(docs).select(utf8(text_col).alias("text")).mapInArrow(partial(_occurrences, size=digest_bytes, key=key), "digest binary, chunk binary").distinct()
        if pairs.groupBy("digest").count().filter("count > 1").isEmpty():
            break
        key, digest_bytes = key + 1, min(64, 2 * digest_bytes)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("recipe", T.BinaryType()), T.StructField("text_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(partial(_recipes, size=digest_bytes, key=key), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """Groups documents with equal texts (white-space runs count as one space).

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``;
    keep_id is the smallest id of the group. Null and empty texts are equal. Rows that repeat
    both id and text are each returned and each kept if theirs is the smallest id; null ids are
    never the smallest unless all are null. Other columns of ``docs`` are not read.

    Groups are aggregated before the join that brings their smallest id back, so a group of any
    size is a count and a minimum, and large groups are dealt over many tasks; only recipes, not
    texts, are joined.
    """
    recipes = cut(chunk_recipes(docs, id_col, text_col, digest_bytes), "recipes")
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.count("*").alias("times"))
    return spread_join(recipes, cut(groups, "groups"), ["recipe"], "times").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes")


OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents) t
WINDOW g AS (PARTITION BY text_sha256)
"""
