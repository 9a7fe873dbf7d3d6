"""Line dedup by content-defined chunks of lines, carried to their neighbours by pairs of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, spread_join, table, utf8


def text_lines(data: bytes) -> tuple[list[bytes], list[int]]:
    """The lines that hold more than white space, without line ends, and where each starts; at the end of the starts, the text's length.

    A line's span goes to the start of the next such line, so blank lines belong to the one above.
    """
    lines, starts, at = [], [], 0
    for line in data.split(b"\n"):
        if line.strip():
            lines.append(line)
            starts.append(at)
        at += len(line) + 1
    return lines, [*starts, len(data)]


def line_chunks(lines: list[bytes], window: int = 2, mean: int = 4, most: int = 256) -> list[int]:
    """Where chunks of lines start, and at the end the number of lines.

    A rolling hash over the hashes of the last ``window`` lines ends a chunk where it is 0 modulo
    ``mean``, so boundaries depend on nearby lines alone and come back in step after an edit. A chunk
    of ``most`` lines ends anyway, by count and not by content: a long stretch without a boundary,
    such as one of equal lines, is cut at places that shift with what stands before it.
    """
    n = len(lines)
    h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, n)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(window, n)):
        rolled[j:] += h[: n - j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    rolled ^= rolled >> np.uint64(31)
    stops = ((rolled * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(32)) % np.uint64(mean) == 0
    out = [0]
    for i, stop in enumerate(stops.tolist(), 1):
        if stop or i - out[-1] == most or i == n:
            out.append(i)
    return out


def _digest(line: bytes, size: int, key: int) -> bytes:
    return hashlib.blake2b(line, digest_size=size, key=key.to_bytes(4, "big")).digest()


def _distinct_lines(batches: Iterator[pa.RecordBatch], size: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = list({line for t in batch.column(0) for line in text_lines(t.as_py())[0]})
        yield pa.RecordBatch.from_arrays([pa.array([_digest(x, size, key) for x in lines], pa.binary()), pa.array(lines, pa.binary())], ["digest", "line"])


def _chunk_rows(batches: Iterator[pa.RecordBatch], size: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, t in enumerate(batch.column(2)):
            lines = text_lines(t.as_py())[0]
            ids = b"".join(_digest(x, size, key) for x in lines)
            cuts = line_chunks(lines)
            rows += [(i, a, b - a, ids[a * size : b * size], ids[b * size : (b + 1) * size]) for a, b in zip(cuts, cuts[1:])]
        i, line, n, ids, after = zip(*rows) if rows else ((),) * 5
        doc = pa.array(i, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(doc), batch.column(1).take(doc), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(after, pa.binary())],
            ["doc_id", "key", "line", "n", "ids", "after"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, gone_lines, gone_chunks, sha, kept = [], [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            lines, starts = text_lines(text)
            gone = np.zeros(len(lines) + 1, bool)  # the last stays False: an end for the last run
            for span in spans.as_py() or ():
                gone[span["line"] : span["line"] + span["n"]] = True
            edges = np.flatnonzero(np.diff(gone, prepend=False)).tolist()
            left, at = [], 0
            for a, b in zip(edges[::2], edges[1::2]):
                left.append(text[at : starts[a]])
                at = starts[b]
            left = b"".join([*left, text[at:]])
            n_lines.append(len(lines))
            gone_lines.append(int(gone.sum()))
            gone_chunks.append(len(edges) // 2)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(gone_lines, pa.int64()), pa.array(gone_chunks, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256", "kept_text"])


def _firsts(met: DataFrame, by: str) -> DataFrame:
    """Of each value of ``by``: how often it is met, and the first place."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line")
    found = met.groupBy(by).agg(F.count("*").alias("times"), F.min(place).alias("first"))
    return found.select(by, "times", F.col("first.key").alias("first_key"), F.col("first.line").alias("first_line"))


def _later() -> Column:
    return (F.col("key") != F.col("first_key")) | (F.col("line") != F.col("first_line"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """Removes passages of two or more lines that occur before, in any document.

    Lines are those that hold more than white space, compared byte by byte without their line end;
    blank lines go with the line above. A line is removed if it is one of two successive lines that
    occur before as two successive lines, in a document with a smaller id (a null id comes last) or
    earlier in its own. So of every line the first occurrence stays, and a repeated passage of two
    lines or more goes as a whole, wherever chunks end. Returns one row per input row: ``doc_id,
    n_lines, n_removed_lines, n_removed_chunks`` (runs of removed lines), ``kept_sha256, kept_text``.
    Null and empty texts have no line. Rows that repeat id and text are treated alike. Other columns
    are not read.

    Every distinct line's bytes are compared once under its digest (should a digest stand for two,
    all are made anew with another key and twice the size), so equal lists of digests are equal
    lines. Content-defined chunks of two or more lines are compared first, as lists: of equal ones
    all but the first go. Pairs of lines then carry on where chunks end: those inside the chunks that
    are left, and those across the end of any chunk. A pair inside a removed chunk needs no row, as
    the first of these chunks holds it too.

    Counts and first places are aggregated by chunk and pair before the joins, so one that occurs
    everywhere is a count and a minimum; a document's list of removed spans is as long as the
    document at most.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"\0"), "text"))))
    key = 0
    while True:
        lines = rows.select("text").mapInArrow(partial(_distinct_lines, size=digest_bytes, key=key), "digest binary, line binary").distinct()
        if lines.groupBy("digest").count().filter("count > 1").isEmpty():
            break
        key, digest_bytes = key + 1, min(64, 2 * digest_bytes)
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    schema = T.StructType([id_field, T.StructField("key", T.BinaryType()), T.StructField("line", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("after", T.BinaryType())])
    chunks = cut(rows.select("doc_id", "key", "text").mapInArrow(partial(_chunk_rows, size=digest_bytes, key=key), schema), "chunks")
    long = chunks.filter("n > 1")
    told = cut(spread_join(long, cut(_firsts(long, "ids"), "first-chunks"), ["ids"], "times").withColumn("gone", _later()).select(*chunks.columns, "gone").unionByName(chunks.filter("n = 1").withColumn("gone", F.lit(False))), "told")
    # The pairs that start at a chunk's lines; the one at its last line ends in the next chunk.
    first = F.when(F.col("gone"), F.col("n") - 1).otherwise(0)
    last = F.when(F.octet_length("after") > 0, F.col("n") - 1).otherwise(F.col("n") - 2)
    at = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("step")
    steps = told.select("doc_id", "key", "line", F.concat("ids", "after").alias("ids"), at)
    pairs = cut(steps.select("doc_id", "key", (F.col("line") + F.col("step")).alias("line"), F.substring("ids", F.col("step") * digest_bytes + 1, F.lit(2 * digest_bytes)).alias("pair")), "pairs")
    again = cut(_firsts(pairs, "pair").filter("times > 1"), "again")
    later = spread_join(pairs, again, ["pair"], "times").filter(_later()).select("key", "line", F.lit(2).alias("n"))
    spans = told.filter("gone").select("key", "line", "n").unionByName(later)
    lists = spans.groupBy("key").agg(F.collect_set(F.struct("line", "n")).alias("spans"))
    out = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed_lines", "n_removed_chunks")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    return rows.join(lists, "key", "left").select("doc_id", "text", "spans").mapInArrow(_kept, out)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")
