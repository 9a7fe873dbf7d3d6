"""Removal of repeated long byte strings by suffix arrays."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, spread_join, table, utf8

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
BLOCK_BITS = 20


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def anchors(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of ``length`` bytes that have the same anchor, as arrays: text, first window, windows, anchor hash.

    A window's anchor is the k bytes in it with the least hash (the first of equal ones), so equal
    windows have equal anchors at the same place.
    """
    wide = length - k + 1
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < 1 << BLOCK_BITS):
            size += len(texts[last])
            last += 1
        if size >= 1 << BLOCK_BITS:  # one text longer than a block: parts that overlap by a window less a byte
            step = (1 << BLOCK_BITS) - length
            for at in range(0, max(1, len(texts[first]) - length + 1), step):
                for text, s, *rest in _anchors([texts[first][at : at + step + length - 1]], length, k, wide):
                    yield text + first, s + at, *rest
        else:
            for text, *rest in _anchors(texts[first:last], length, k, wide):
                yield text + first, *rest
        first = last


def _anchors(texts: list[bytes], length: int, k: int, wide: int) -> Iterator[tuple[np.ndarray, ...]]:
    sizes = np.array([len(t) for t in texts])
    n = int(sizes.sum())
    if n < length:
        return
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = _powers(_R, (1 << BLOCK_BITS) + 1)[: n + 1], _powers(_R_INVERSE, (1 << BLOCK_BITS) + 1)[: n + 1]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = _mixed((total[k:] - total[:-k]) * down[: n - k + 1])
    least = (h & ~np.uint64((1 << BLOCK_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(h) - wide + 1], least[wide - span :])
    at = (least & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)  # anchor of the window that starts here
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    whole = np.arange(len(at)) + length <= ends[text]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(fresh)
    count = np.diff(np.append(starts, len(at)))
    keep = whole[starts]
    starts, count = starts[keep], count[keep]
    yield text[starts], starts - (ends - sizes)[text[starts]], count, h[at[starts]]


def _anchor_hashes(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, h in anchors(batch.column(0).to_pylist(), length, k):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, texts = batch.column(0), batch.column(1).to_pylist()
        for text, start, count, h in anchors(texts, length, k):
            stop = (start + count + length - 1).tolist()
            d1, d2 = _halves([xxhash.xxh3_128_digest(texts[i][a:b]) for i, a, b in zip(text.tolist(), start.tolist(), stop)])
            yield pa.RecordBatch.from_arrays([key.take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(h.view(np.int64)), d1, d2], ["key", "start", "n", "h", "d1", "d2"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for batch in batches:
        rows = [(w["h"], w["d1"], w["d2"], w["copy"], w["n"], t[w["start"] : w["start"] + w["n"] + length - 1]) for t, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in ws]
        yield _record(rows, (("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("copy", pa.int32()), ("n", pa.int32()), ("data", pa.binary())))


def _record(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def _sorted_by_prefix(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Order of the strings of ``length`` bytes that start at ``at``: eight bytes at a time, each time only what still ties."""
    order = np.argsort(words[at], kind="stable")
    key = words[at[order]]
    fresh = np.ones(len(at), bool)
    fresh[1:] = key[1:] != key[:-1]
    for step in range(8, length, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(fresh)[where]
        own = order[where]
        key = words[at[own] + step]
        sort = np.lexsort((key, group))
        order[where] = own[sort]
        key = key[sort]
        fresh[where[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order


def repeated_windows(texts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """Which of the first ``windows[i]`` strings of ``length`` bytes of ``texts[i]`` occur at another of these places.

    Two-stage suffix sorting over the places: suffixes smaller than their successor (type B) are
    sorted directly, by ``length`` bytes; then buckets of first bytes are scanned in order, and every
    place met puts its predecessor, if larger than its successor (type A), at the end of the front
    part of that one's bucket. Beyond the last place a text goes on to its next type B suffix, which
    its type A suffixes are induced from. Neighbours in the array are compared for common prefixes.
    """
    pad = bytes(length + 8)
    data = np.frombuffer(b"".join(t + pad for t in texts) + pad, np.uint8)
    words = np.zeros(len(data), np.uint64)
    for j in range(8):
        words[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = (np.cumsum(sizes + len(pad)) - sizes - len(pad)).astype(np.int64)
    up = np.zeros(len(data), bool)  # type B
    differs = np.flatnonzero(data[:-1] != data[1:])
    if len(differs):  # a byte is as the last one of its run of equal bytes
        rises = data[differs] < data[differs + 1]
        up[: differs[-1] + 1] = np.repeat(rises, np.diff(differs, prepend=-1))
    windows = np.array(windows, np.int64)
    stops = np.flatnonzero(up)  # the next type B suffix, or the end
    last = first + windows - 1
    n = np.minimum(np.append(stops, len(data))[np.searchsorted(stops, last)], first + sizes - 1) - first + 1
    n = np.where(windows > 0, n, 0)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    if not len(at):
        return [np.zeros(0, bool) for _ in texts]
    byte, b = data[at], up[at]
    has_previous = np.ones(len(at), bool)
    has_previous[(np.cumsum(n) - n)[n > 0]] = False
    which = np.flatnonzero(b)
    which = which[_sorted_by_prefix(words, at[which], length)]
    edges = np.searchsorted(byte[which], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def dealt(places: np.ndarray) -> None:
        sort = np.argsort(byte[places], kind="stable")
        places = places[sort]
        to, begin = np.unique(byte[places], return_index=True)
        for c, part in zip(to.tolist(), np.split(places, begin[1:])):
            fronts[c].append(part)

    ends = np.cumsum(n)[n > 0] - 1
    dealt(ends[~b[ends]])  # texts that have no further type B suffix: their successor is the empty one
    array = []
    for c in range(256):
        now = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        while len(now):
            array.append(now)
            before = now[has_previous[now]] - 1
            before = before[~b[before]]
            same = byte[before] == c
            dealt(before[~same])
            now = before[same]
        back = which[edges[c] : edges[c + 1]]
        array.append(back)
        before = back[has_previous[back]] - 1
        dealt(before[~b[before]])
    of = np.repeat(np.arange(len(texts)), n)
    is_window = at - first[of] < windows[of]
    order = np.concatenate(array)
    order = order[is_window[order]]
    left, right = at[order[:-1]], at[order[1:]]
    alive = np.arange(len(left))
    for step in range(0, length - 7, 8):
        alive = alive[words[left[alive] + step] == words[right[alive] + step]]
    for j in range(length - length % 8, length):
        alive = alive[data[left[alive] + j] == data[right[alive] + j]]
    found = np.zeros(len(at), bool)
    found[order[alive]] = found[order[alive + 1]] = True
    ends = np.cumsum(n)
    return [found[e - m : e - m + w] for e, m, w in zip(ends.tolist(), n.tolist(), windows.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _by_suffix_array(part: pa.Table, length: int) -> pa.Table:
    """The repeated windows of the runs of a part, as places in their groups.

    Of a pair whose bytes are equal one run is enough: all windows of its group are repeated, and it
    is sorted only if its anchor has other runs that it may meet.
    """
    h, d1, d2, n, data = (part.column(c).to_pylist() for c in ("h", "d1", "d2", "n", "data"))
    out, kept, own = [], [], {}
    for i, group in enumerate(zip(h, d1, d2)):
        at = own.setdefault(group, i)
        if at < i and data[at] == data[i]:
            out.append((*group, 0, n[i]))
        else:
            kept.append(i)
    runs = Counter(h[i] for i in kept)
    kept = [i for i in kept if runs[h[i]] > 1]
    for i, flags in zip(kept, repeated_windows([data[i] for i in kept], [n[i] for i in kept], length)):
        out += [(h[i], d1[i], d2[i], a, m) for a, m in zip(*_runs(flags))]
    return pa.Table.from_batches([_record(out, (("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.int32()), ("n", pa.int32())))])


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each window of the runs of a batch with its own digest."""
    for batch in batches:
        h, d1, d2, copy, n, data = (batch.column(c) for c in ("h", "d1", "d2", "copy", "n", "data"))
        count = n.to_numpy()
        run = pa.array(np.repeat(np.arange(len(count)), count))
        at = np.concatenate([np.arange(m) for m in count]) if len(count) else np.zeros(0)
        w1, w2 = _halves([xxhash.xxh3_128_digest(t[i : i + length]) for t, m in zip(data.to_pylist(), count.tolist()) for i in range(m)])
        yield pa.RecordBatch.from_arrays([w1, w2, h.take(run), d1.take(run), d2.take(run), copy.take(run), pa.array(at.astype(np.int32))], ["w1", "w2", "h", "d1", "d2", "copy", "at"])


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, spans, sha, where = [], [], [], [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for a, n in sorted({(r["start"] + x["at"], x["n"]) for r in ranges or () for x in r["found"]}):
                b = a + n - 1 + length
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept = hashlib.sha256()
            at = 0
            for a, b in merged:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            size.append(len(text))
            removed.append(sum(b - a for a, b in merged))
            spans.append(len(merged))
            sha.append(kept.hexdigest())
            where.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, anchor: int = 64, part_bytes: int = 2 << 20) -> DataFrame:
    """Finds every byte covered by a string of ``length`` bytes that starts at another place of any text, too.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``, with
    the maximal spans of such bytes as ``spans(start, end)`` and the hash of what is left. Texts are
    UTF-8 bytes; null counts as empty; nothing matches across texts; rows that repeat id and text
    are repeats of each other. Other columns are not read.

    1. Windows of ``length`` bytes are grouped into runs by their anchor, the ``anchor`` bytes with
       the least hash in them. Equal windows have equal anchors, so runs whose anchor is met once
       are done: counts by hash, aggregated before they are shuffled, leave few candidates.
    2. Runs with one anchor and one 128-bit digest are a group. One run of a group of one is cut out
       of its text, of others a pair, whose bytes are compared: if they are equal, all windows of the
       group are repeated. Two-stage suffix sorting of all distinct runs of the same anchors with
       adjacent common prefixes finds the other windows that are repeated (see `repeated_windows`).
       Parts hold about ``part_bytes``.
    3. An anchor with more bytes than a part is split by further bytes: each window becomes a run
       with its own digest as the anchor. Those met once are done, of others a pair is compared.

    Texts are read again to cut runs out and to remove the spans; they are joined by a 128-bit hash
    of id and text. Joins on anchors, groups and windows deal frequent keys over many tasks.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"\0"), "text"))))
    group, window = ["h", "d1", "d2"], ["w1", "w2"]
    counts = rows.select("text").mapInArrow(partial(_anchor_hashes, length=length, k=anchor), "h long").groupBy("h").agg(F.count("*").alias("times")).filter("times > 1")
    runs = rows.select("key", "text").mapInArrow(partial(_anchor_rows, length=length, k=anchor), "key binary, start int, n int, h long, d1 long, d2 long")
    met = cut(spread_join(runs, cut(counts, "anchors"), ["h"], "times"), "runs")
    place = F.struct("key", "start", "n")
    groups = cut(met.groupBy(group).agg(F.count("*").alias("times"), F.min(place).alias("first"), F.max(place).alias("last")), "groups")
    copies = groups.select(*group, F.posexplode(F.when(F.col("times") > 1, F.array("first", "last")).otherwise(F.array("first"))).alias("copy", "place"))
    asked = copies.groupBy("place.key").agg(F.collect_list(F.struct("place.start", "place.n", *group, "copy")).alias("wanted"))
    texts = rows.select("key", "text").join(asked, "key").dropDuplicates(["key"]).select("text", "wanted")
    data = cut(texts.mapInArrow(partial(_cut_out, length=length), "h long, d1 long, d2 long, copy int, n int, data binary"), "cut")
    sizes = data.groupBy("h").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("times"))
    wide = cut(sizes.filter(F.col("bytes") > part_bytes), "wide")
    split = cut(spread_join(data, wide, ["h"], "times").mapInArrow(partial(_window_rows, length=length), "w1 long, w2 long, h long, d1 long, d2 long, copy int, at int"), "windows")
    owner = F.struct(*group, "copy", "at")
    again = cut(split.groupBy(window).agg(F.count("*").alias("times"), F.min(owner).alias("first"), F.max(owner).alias("last")).filter("times > 1"), "again")
    ends = again.select(*window, F.explode(F.array("first", "last")).alias("own")).select(*window, "own.*")
    pairs = data.join(ends, [*group, "copy"]).select(F.col("w1").alias("h"), F.col("w1").alias("d1"), F.col("w2").alias("d2"), F.lit(1).alias("n"), F.substring("data", F.col("at") + 1, F.lit(length)).alias("data"))
    sorted_ = data.join(wide, "h", "left_anti").select(*group, "n", "data").unionByName(pairs)
    parts = max(1, math.ceil((sizes.agg(F.sum(F.least("bytes", F.lit(part_bytes)))).first()[0] or 0) / part_bytes))

    def sorted_part(part: pa.Table) -> pa.Table:
        return _by_suffix_array(part, length)

    found = cut(sorted_.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts))).groupBy("part").applyInArrow(sorted_part, "h long, d1 long, d2 long, at int, n int"), "found")
    same = found.filter("h = d1").select(F.col("d1").alias("w1"), F.col("d2").alias("w2")).distinct().join(again.select(*window, "times"), window)
    split_found = spread_join(split, cut(same, "same"), window, "times").select(*group, "at", F.lit(1).alias("n"))
    whole = found.filter("h <> d1").unionByName(split_found)
    found_in = whole.groupBy(group).agg(F.collect_set(F.struct("at", "n")).alias("found")).join(groups.select(*group, "times"), group)
    spans = spread_join(met, cut(found_in, "spans"), group, "times")
    ranges = spans.groupBy("key").agg(F.collect_set(F.struct("start", "found")).alias("ranges"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return rows.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(partial(_removed, length=length), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
