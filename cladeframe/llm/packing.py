"""Best-fit packing of token sequences, certified by dual-feasible bounds."""

from __future__ import annotations

import json
import math
import operator
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, table

#: Parts of texts, and plain words, that a worker keeps encoded in the newer of two generations; the older one goes when it is full.
CACHED_PARTS, CACHED_WORDS = 250_000, 450_000
#: Letters that lower-case one by one and make one word for the tokenizer, then marks that make the next.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:-@\[-^`{-~]*)")
#: Characters whose lower case may depend on more than themselves, or that may join others.
JOINING = re.compile(r"[İ\u0250-\U0010FFFF]")


def _splits_words(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, splits at white space before all else, and marks the end of each word.

    Its own settings say so, and words tried alone and together must give the same ids.
    """
    said = json.loads(tokenizer.to_str())
    normal, model = said.get("normalizer") or {}, said.get("model") or {}
    steps = [x.get("type") for x in normal.get("normalizers", [normal])]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or not {"Lowercase", "Replace"} <= set(steps):
        return False
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return all(ids(f"{a} {b}") == ids(f" {a}\n\t{b} ") == ids(a) + ids(b) for a, b in (("The", "end."), ("Éa", "x-1"), ("don't", "GO"), ("é,", "(b)")))


class _Encoder:
    """The ids of texts as little-endian 32-bit integers.

    A tokenizer of another kind than `_splits_words` says encodes whole texts. This kind splits at white space before it does anything that looks further, so the ids of a
    text are those of its space-separated parts, one after the other, and each distinct part is
    encoded once. A plain word with marks behind it is in turn the ids of the word in lower case,
    which the tokenizer takes as well, and those of the marks; new plain words are encoded together, told apart by their end tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        self.by_words = _splits_words(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.older_parts: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _apart(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._apart(words)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def _learn(self, parts: list[str]) -> None:
        names, firsts, marks, odd = [], [], [], []
        for w, m in zip(parts, map(PLAIN.fullmatch, parts)):
            if m:
                names.append(w)
                firsts.append(m[1].lower())
                marks.append(m[2])
            else:
                odd.append(w)
        if len(self.words) > CACHED_WORDS:
            self.words, self.older_words = {"": b""}, self.words
        new = set(firsts).difference(self.words)
        again = [w for w in new if w in self.older_words]
        self.words.update(zip(again, map(self.older_words.__getitem__, again)))
        new = list(new.difference(again))
        for at in range(0, len(new), 5000):
            self.words.update(zip(new[at : at + 5000], self._together(new[at : at + 5000])))
        unmet = list(set(marks).difference(self.words))
        self.words.update(zip(unmet, self._apart(unmet)))
        of = self.words.__getitem__
        self.parts.update(zip(names, map(operator.add, map(of, firsts), map(of, marks))))
        self.parts.update(zip(odd, self._apart(odd)))

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.by_words:
            yield from self._apart([t or "" for t in texts])
            return
        split = []
        for t in texts:
            t = t or ""
            t = t.lower() if t.isascii() or not JOINING.search(t) else t
            split.append(t.replace("\n", " ").replace("\t", " ").split(" "))
        found = set().union(*split)
        new = found.difference(self.parts)
        if len(self.parts) + len(new) > CACHED_PARTS:
            self.parts, self.older_parts, new = {}, self.parts, found
        again = [w for w in new if w in self.older_parts]  # set.intersection would go through the whole dict
        self.parts.update(zip(again, map(self.older_parts.__getitem__, again)))
        self._learn(list(new.difference(again)))
        for p in split:
            yield b"".join(map(self.parts.__getitem__, p))


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first in range(0, len(texts), 500):
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(_encoder(path)(texts[first : first + 500]), first):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's token ids and one ``end_id``, cut into pieces of ``capacity`` only where longer.

    Returns ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit). A null text counts as empty: one piece that holds the end id. Any tokenizer
    file of the tokenizers library will do. Strings of its special tokens that stand in a text are
    encoded as ordinary text, as the tokenizers' own notes have it.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.BinaryType())] * with_ids)
    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_pieces, path=tokenizer_path, capacity=capacity, end_id=end_id, with_ids=with_ids), schema)


def dual_feasible_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions.

    One counts sizes over ``capacity - s`` as full, drops those under ``s`` and keeps the rest, for
    each s up to half the capacity (s = 0 is the plain sum); the other rounds to multiples of 1/k.
    """
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    s = np.arange(capacity // 2 + 1)
    full = count[-1] - count[capacity - s + 1]
    best = int(np.max(-(-(capacity * full + total[capacity - s + 1] - total[s]) // capacity)))
    for k in range(1, 32):
        steps = (k + 1) * size
        u = np.where(steps % capacity == 0, size * k, steps // capacity * capacity)
        best = max(best, -(-int((n * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds: each item, longest first, goes where it leaves least room."""
    bins, offsets, held = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(held)
            held.append(0)
        bins[i], offsets[i] = at, held[at]
        held[at] += x
        by_room[room - x].append(at)
        rooms |= 1 << (room - x)
    return bins, offsets, np.array(held, np.int64)


def _packer(capacity: int, number: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def packed(group: pa.Table) -> pa.Table:
        return _pack(group, capacity, number, last)

    return packed


def _pack(group: pa.Table, capacity: int, number: int, last: bool) -> pa.Table:
    lengths = group.column("length").to_numpy()
    bins, offsets, held = best_fit_decreasing(lengths, capacity)
    gap = len(held) - dual_feasible_bound(lengths, capacity)
    settled = np.ones(len(held), bool)
    if not last:  # release the emptiest bins: those of the gap and the room of one more
        order = np.argsort(held, kind="stable")
        room = np.cumsum(capacity - held[order])
        settled[order[: np.searchsorted(room, (gap + 1) * capacity) + 1]] = held[order[: np.searchsorted(room, (gap + 1) * capacity) + 1]] == capacity
    which = group.column("part")[0].as_py()
    sequence = (number << 56) + (which << 28) + bins
    for name, values in (("sequence_id", sequence), ("offset", offsets), ("settled", settled[bins]), ("gap", np.full(len(bins), gap))):
        group = group.append_column(name, pa.array(values))
    return group.drop_columns(["part"])


def pack(pieces: DataFrame, capacity: int = 2048, part_size: int = 20_000, max_rounds: int = 8) -> DataFrame:
    """Packs pieces into as few sequences of ``capacity`` as it can; adds ``sequence_id, offset, gap``.

    ``pieces`` has ``doc_id, piece, length`` with lengths from 1 to capacity, and any further columns,
    which are kept (``part``, ``sequence_id``, ``offset``, ``settled``, ``gap`` are replaced). Pieces
    are dealt by a hash of their row number, so that repeated and null ids spread, to parts of about ``part_size``; each part is packed best-fit decreasing and
    its bin count held against dual-feasible lower bounds. A part at its bound is certified and
    gives up its emptiest bins alone, a part above gives up the bins of its gap as well; what they
    give up is dealt anew, to fewer parts, and packed again, until one part holds all that is left.
    ``gap`` is the number of bins over the bound of the part that settled the row. A part is of
    bounded size in every round; after ``max_rounds`` what is left is settled as it lies. An empty
    table gives an empty table; rows that repeat are packed each. Of pieces of one length the first
    in the part goes first, and of bins with the same room the one that got it last.
    """
    pieces = pieces.drop("part", "sequence_id", "offset", "settled", "gap")
    rest, done, number = cut(pieces, "pieces"), [], 0
    n = rest.count()
    while n or not done:
        parts = max(1, math.ceil(n / part_size))
        last = parts == 1 or number + 1 == max_rounds
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(parts)))
        schema = T.StructType([*rest.schema.fields, *(T.StructField(k, T.BooleanType() if k == "settled" else T.LongType()) for k in ("sequence_id", "offset", "settled", "gap"))])
        found = cut(dealt.groupBy("part").applyInArrow(_packer(capacity, number, last), schema), "packed")
        done.append(found.filter("settled").drop("settled"))
        rest = found.filter("not settled").select(pieces.columns)
        n, number = 0 if last else rest.count(), number + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokens of all documents in sequences of at most ``capacity``: one row per piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap`` and, if asked for,
    ``ids``. Other columns of ``docs`` are not read.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
