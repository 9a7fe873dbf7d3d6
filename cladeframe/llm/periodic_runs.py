"""Periodic runs of words in documents, found on enhanced suffix arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, utf8

#: Words that are held in arrays at once; a longer document is taken alone.
GROUP_WORDS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on; the last n - 1 places have none."""
    powers, h, got = {1: _mixed(words.astype(np.uint64) + np.uint64(1))}, None, 0
    step = 1
    while 2 * step <= n:
        p = powers[step]
        powers[2 * step] = _mixed(p[:-step] * np.uint64(3) + _mixed(p[step:]))
        step *= 2
    for step, p in sorted(powers.items(), reverse=True):
        if n - got >= step:
            h = p[: len(words) - step + 1] if h is None else _mixed(h[: len(words) - got - step + 1] * np.uint64(5) + p[got:])
            got += step
    return h


def zones(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of the stretches covered by strings of ``n`` words that occur twice in their document.

    Two strings may be taken for equal when their hashes are; a zone too many holds no run.
    """
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[: len(words) - n + 1] == doc[n - 1 :])
    h = _gram_hashes(words, n)[whole] ^ _mixed(doc[whole].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.sort(whole[again])
    if not len(at):
        return at, at
    apart = np.flatnonzero((at[1:] > at[:-1] + n) | (doc[at[1:]] != doc[at[:-1]]))
    return at[np.append(0, apart + 1)], at[np.append(apart, len(at) - 1)] + n


def _ranks(words: np.ndarray, zone: np.ndarray) -> list[np.ndarray]:
    """By level k, the rank of the first 2**k words from each place within its zone; in the last one all differ.

    Ends of zones sort first, so equal ranks mean equal words that lie within one zone.
    """
    n = len(words)
    out = [np.unique(zone * (words.max() + 1) + words, return_inverse=True)[1]]
    step = 1
    while out[-1].max() + 1 < n:
        then = np.zeros(n, np.int64)
        then[: n - step] = np.where(zone[: n - step] == zone[step:], out[-1][step:] + 1, 0)
        out.append(np.unique(out[-1] * (n + 1) + then, return_inverse=True)[1])
        step *= 2
    return out


def _jump(depth: np.ndarray, at: np.ndarray, step: int, beyond: Callable) -> np.ndarray:
    """For each boundary ``at`` the nearest one in the direction ``step`` whose depth isn't ``beyond`` its own: all jump over what others have passed."""
    to = np.arange(len(depth)) + step
    open_ = at
    while len(open_):
        open_ = open_[beyond(depth[to[open_]], depth[open_])]
        to[open_] = to[to[open_]]
    return to


def branching_squares(ranks: list[np.ndarray], zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods d with d words that stand at i and again at i + d, and another word (or the end) after the second than after the first.

    The suffix array with its common prefixes is cut into intervals of suffixes that share ``depth``
    words. In each the suffixes of all children but the largest are looked at: i and i + d are a
    square if both lie in the interval, known from their places in the array, and it branches if
    they lie in different children. The intervals are arrays of bounds; there is no tree.
    """
    place = ranks[-1]
    n = len(place)
    array = np.empty(n, np.int64)
    array[place] = np.arange(n)
    a, b, common = array[:-1], array[1:], np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[ranks[level][x[inside]] == ranks[level][y[inside]]]
        common[same] += 1 << level
    depth = np.concatenate([[-1], common, [-1]])  # of the boundary before each place in the array
    at = np.flatnonzero(depth > 0)
    left, right = (_jump(depth, at, step, np.greater_equal) for step in (-1, 1))
    back, on = (_jump(depth, at, step, np.greater) for step in (-1, 1))
    last = at[depth[on[at]] < depth[at]]
    child_first, child_past = np.concatenate([back[at], last]), np.concatenate([at, on[last]])
    of = np.concatenate([at, last])  # a boundary of the child's interval
    size = child_past - child_first
    own = left[of] * (n + 1) + right[of]
    order = np.lexsort((-size, own))
    largest = np.ones(len(order), bool)
    largest[1:] = own[order[1:]] != own[order[:-1]]
    small = order[~largest]
    times = size[small]
    row = np.repeat(small, times)
    i = array[np.repeat(child_first[small] - np.cumsum(times) + times, times) + np.arange(len(row))]
    d, low, past, first, end = depth[of[row]], left[of[row]], right[of[row]], child_first[row], child_past[row]
    found = []
    for j in (i + d, i - d):
        ok = np.flatnonzero((j >= 0) & (j < n))
        ok = ok[zone[j[ok]] == zone[i[ok]]]
        p = place[j[ok]]
        ok = ok[(p >= low[ok]) & (p < past[ok]) & ~((p >= first[ok]) & (p < end[ok]))]
        found.append((np.minimum(i[ok], j[ok]), d[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_in_zones(words: np.ndarray, zone: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of the runs of each zone: squares are rotated to the left as far as they go, and those that meet in one stretch are merged."""
    ranks = _ranks(words, zone)
    i, d = branching_squares(ranks, zone)
    turns = np.zeros(len(i), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x = i - turns - (1 << level)
        ok = np.flatnonzero(x >= 0)
        ok = ok[ranks[level][x[ok]] == ranks[level][x[ok] + d[ok]]]
        turns[ok] += 1 << level
    start, length = i - turns, 2 * d + turns
    ok = length >= np.maximum(least_length, least_exponent * d)
    start, length, d = start[ok], length[ok], d[ok]
    order = np.lexsort((d, length, start))
    start, length, d = start[order], length[order], d[order]
    first = np.ones(len(order), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], d[first]


def periodic_runs(docs: list[list[bytes]], least_length: int = 24, least_exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """Per document, a list of words, its runs ``(start, length, period)`` by start, then period.

    In a run of length n and period q the words from its start on and from start + q on are the same
    n - q or more words, so runs lie within the zones of strings of that many words that repeat.
    """
    number = defaultdict(count().__next__)
    sizes = [len(d) for d in docs]
    words = np.fromiter((number[w] for d in docs for w in d), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(docs)), sizes)
    first, past = zones(words, doc, least_length - least_length // least_exponent)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not len(first):
        return out
    width = past - first
    begin = np.cumsum(width) - width
    zone = np.repeat(np.arange(len(first)), width)
    at = np.arange(len(zone)) + np.repeat(first - begin, width)
    start, length, period = runs_in_zones(words[at], zone, least_length, least_exponent)
    began = np.cumsum(sizes) - sizes
    for s, n, q in zip(at[start].tolist(), length.tolist(), period.tolist()):
        out[doc[s]].append((s - int(began[doc[s]]), n, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def planted(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words with a stretch made periodic, in the documents that the hash of the id picks."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    kept, at = [], 0
    for s, e in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:s]
        at = max(at, e)
    kept += words[at:]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FIELDS = (
    *((c, T.LongType(), pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
    *((c, T.StringType(), pa.string()) for c in ("runs_sha256", "collapsed_sha256")),
    ("runs", T.ArrayType(_RUN), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
)


def _grouped(split: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for words in split:
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _rows(batches: Iterator[pa.RecordBatch], least_length: int, least_exponent: int, plant: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch.column(2), batch.column(1)
        split = (planted(t.as_py().split(), i.as_py()) if plant else t.as_py().split() for t, i in zip(texts, ids))
        done = 0
        for group in _grouped(split):
            rows = [_described(w, r) for w, r in zip(group, periodic_runs(group, least_length, least_exponent))]
            columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows), _FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), *columns], ["doc_id", *(name for name, _, _ in _FIELDS)])
            done += len(group)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 24, least_exponent: int = 3, plant: bool = False) -> DataFrame:
    """The periodic runs of words of each document, one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least
    ``least_length`` words and ``least_exponent`` (2 or more) of its smallest period q in which words
    q apart are the same, and which no neighbouring word extends. Returns ``doc_id, n_runs``; ``start,
    length, period, exponent_milli`` of the run with the greatest length / period (exact; the first
    start, then the smallest period on ties; null without runs); ``runs_sha256`` over ``start,length,period``
    lines; ``collapsed_sha256`` over the words left when each run keeps its first period only, joined
    by spaces; and ``runs``, all of them. Null and empty texts have no words and no runs; repeated
    rows have the same result each; columns other than the two are not read. With ``plant`` every
    document whose id's crc32 is a multiple of 10 gets a periodic stretch first (a null id counts as `null`).

    Documents are looked at where they lie: nothing is shuffled. A worker holds a batch, and arrays
    for ``GROUP_WORDS`` words or one longer document.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(name, kind) for name, kind, _ in _FIELDS)])
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), name.alias("name"), utf8(text_col).alias("text"))
    return rows.mapInArrow(partial(_rows, least_length=least_length, least_exponent=least_exponent, plant=plant), schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs")
