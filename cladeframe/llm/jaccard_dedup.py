"""Near-dedup by Jaccard similarity of shingles: bands of minimum hashes find the pairs, the sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, spread_join, utf8
from .components import connected_components
from .decontamination import _hashed, _shingled, _words

#: Keeps a rounding error of a product from cutting a pair at the very bound.
SLACK = 1e-9
#: Least bits of a sketch; one has at least `BITS` for each shingle of its set.
WIDTH, BITS = 1024, 4
#: Bands of a text and minimum hashes of a band: of pairs at a similarity of 0.8 under one in 100,000 shares no band.
BANDS, BAND = 30, 5
#: Nodes of a band that are held against each other at once, and bytes of their sketches.
BLOCK, BLOCK_BYTES = 1000, 1 << 19
_ODD = np.random.default_rng(5).integers(0, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes, k: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one without words has the hash 0 alone."""
    words = _words(data)
    return np.unique(_shingled(_hashed(words, known), min(k, len(words)))) if words else np.zeros(1, np.uint64)


def _node(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes(), seed)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A key per band: the hash of its minima, each of all shingles under another multiplier."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _ODD).min(axis=0))
    return _shingled(np.append(least, np.arange(BANDS, dtype=np.uint64)).reshape(BAND + 1, BANDS).T.ravel(), BAND + 1)[:: BAND + 1]


def _sketch(shingles: np.ndarray) -> bytes:
    """Per residue of the hashes whether an odd number have it: two sets differ in at least as many shingles as their sketches in bits.

    The width is a power of two and grows with the set, so that long texts are told apart as well as
    short ones; sketches of two widths are compared at the lesser one (`_folded`).
    """
    width = max(WIDTH, 1 << (BITS * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width) % 2, bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch, as 64-bit words, at a lesser width."""
    return sketch if len(sketch) == words else np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _drawn(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        sets = [shingle_set(t, k, known) for t in batch.column(1).to_pylist()]
        node, check = zip(*(_node(s, seed) for s in sets)) if sets else ((), ())
        keys = np.concatenate([_bands(s) for s in sets]) if sets else np.zeros(0, np.uint64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([_sketch(s) for s in sets], pa.binary()), bands], ["doc_id", "node", "check", "n", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        sets = [shingle_set(t, k, known) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s, seed)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])


def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b`` whose sketches (columns 2 and 3) allow the similarity at their joint size (column 4)."""
    for batch in batches:
        apart = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            words = min(len(x), len(y))
            apart.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64)))
        ok = np.array(apart, np.int64) <= (1 - least) / (1 + least) * batch.column(4).to_numpy() + SLACK
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of two blocks of nodes the pairs of different classes whose sizes and sketches allow the similarity."""
    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1)):
            own, other = ([np.frombuffer(v.as_buffer(), np.uint64) for v in x.values.field("sketch")] for x in (one, two))
            words = min(map(len, own + other))
            sa, sb = (np.stack([_folded(v, words) for v in x]) for x in (own, other))
            (a, na, ca), (b, nb, cb) = ([x.values.field(c).to_numpy() for c in ("node", "n", "class")] for x in (one, two))
            step = max(1, (1 << 22) // (words * len(b)))
            for at in range(0, len(a), step):
                part = slice(at, at + step)
                apart = np.bitwise_count(sa[part, None] ^ sb[None]).sum(axis=2, dtype=np.int64)
                total = na[part, None] + nb
                alike = np.minimum(na[part, None], nb) >= least * np.maximum(na[part, None], nb) - SLACK
                x, y = np.nonzero(alike & (ca[part, None] != cb) & (apart <= (1 - least) / (1 + least) * total + SLACK))
                low, high = np.minimum(a[part][x], b[y]), np.maximum(a[part][x], b[y])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(both >= least * (len(a) + len(b) - both) - SLACK)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, least_similarity: float = 0.8) -> DataFrame:
    """Near-duplicate classes of documents: ``doc_id, node, component_id``, one row per input row.

    Documents are linked when the Jaccard similarity of their sets of shingles is at least
    ``least_similarity``; component_id is the smallest id reachable. Ids may not be null. Words are
    those of `simhash`; null and empty texts are alike. Equal sets are one node.

    Sets meet where they share a band of minimum hashes (`BANDS`). Of a band's nodes each is first
    held against the most central one, whose bands are the most frequent: the text that others are
    copies of, which links a large group with few pairs. Then nodes of different classes that meet
    are held against each other in blocks of like sizes, by their sizes and sketches, whose width
    grows with the text; pairs that these allow become rows, and their sets decide.
    """
    source = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    seed = 0
    while True:  # node and check are 128 bits of a set's hash; should a node stand for two sets, all are named anew
        rows = cut(source.mapInArrow(partial(_drawn, k=words_per_shingle, seed=seed), schema), "bands")
        own = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("check").alias("check"), F.max("check").alias("other"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("times"))
        own = cut(own, "nodes")
        if own.filter("check <> other").isEmpty():
            break
        seed += 1
    own = own.select("node", "least", "n", "sketch", "times")
    places = rows.select("node", "n", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("times")).filter("low < high").select("band", "times", F.col("times").alias("size"))
    met = cut(spread_join(places, cut(shared, "shared"), ["band"], "times").distinct(), "met")
    central = met.groupBy("node").agg(F.sum("size").alias("central"))
    met = cut(met.join(central, "node").select("band", "node", "n", "size", "central"), "central")

    def place(name: str) -> Column:
        return F.struct("node", "n").alias(name)

    def possible(pairs: DataFrame) -> DataFrame:
        """Of the pairs of places ``x, y`` those whose sizes and sketches allow the similarity, as ``a, b``."""
        may = F.least("x.n", "y.n") >= least_similarity * F.greatest("x.n", "y.n") - SLACK
        pairs = pairs.filter(may).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        sketches = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
        drawn = pairs.join(sketches[0], "a").join(sketches[1], "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))
        return drawn.mapInArrow(partial(_possible, least=least_similarity), "a long, b long")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of the pairs ``a, b`` those whose sets are similar."""
        pairs = cut(pairs, f"{name}_pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        least = cut(own.join(wanted, "node", "left_semi").select("least"), f"{name}_wanted")
        texts = source.join(least.select(F.col("least").alias("doc_id")), "doc_id", "left_semi").select("text")
        sets = cut(texts.mapInArrow(partial(_sets, k=words_per_shingle, seed=seed), "node long, set binary").dropDuplicates(["node"]), f"{name}_sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        return cut(both.mapInArrow(partial(_similar, least=least_similarity), "a long, b long"), f"{name}_links")

    def star(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Links of each band's most central member to those of other classes, and the members without it."""
        hub = F.max(F.struct("central", "node", "n", "class"))
        hubs = cut(members.groupBy("band").agg(hub.alias("hub"), F.count("*").alias("times")).select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.class").alias("hub_class"), "times"), f"{name}_hubs")
        beside = cut(spread_join(members, hubs, ["band"], "times").filter("node <> hub"), f"{name}_beside")
        pairs = beside.filter("class <> hub_class").select(place("x"), F.struct(F.col("hub").alias("node"), F.col("hub_n").alias("n")).alias("y"))
        return linked(possible(pairs), name), beside.select(members.columns)

    first, left = star(met.withColumn("class", F.col("node")), "first")
    nodes = cut(connected_components(first), "components")
    known = left.drop("class").join(nodes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    mixed = known.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("band")
    # sets whose sizes are a factor of 0.8 apart or less lie in one class of sizes or in neighbouring ones
    size = F.floor(F.log("n") / -math.log(least_similarity) + SLACK)
    apart = cut(known.join(mixed, "band").join(own.select("node", "sketch"), "node").select("band", size.alias("size"), "node", "n", "class", "sketch"), "mixed")
    count = apart.groupBy("band", "size").agg(F.count("*").alias("times"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("sketch")) / BLOCK_BYTES)).alias("all"))
    member = F.struct("node", "n", "class", "sketch")
    blocks = cut(spread_join(apart, cut(count, "counts"), ["band", "size"], "times").withColumn("block", F.pmod(F.xxhash64("node"), F.col("all"))).groupBy("band", "size", "block").agg(F.collect_list(member).alias("members")), "blocks")
    one = blocks.select("band", F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("size").alias("own"), "block", "members")
    two = blocks.select("band", "size", F.col("block").alias("other"), F.col("members").alias("others"))
    pairs = one.join(two, ["band", "size"]).filter("own < size or block <= other").select("members", "others")
    rest = linked(pairs.mapInArrow(partial(_compared, least=least_similarity), "a long, b long").distinct(), "rest")
    nodes = cut(connected_components(first.unionByName(rest)), "components")
    classed = cut(own.join(nodes, "node", "left").select("node", "least", "times", F.coalesce("component", "node").alias("component")), "classed")
    least = cut(classed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "least")
    named = cut(spread_join(classed.select("node", "times", "component"), least, ["component"], "nodes").select("node", "times", "component_id"), "named")
    return spread_join(rows.select("doc_id", "node"), named, ["node"], "times").select("doc_id", "node", "component_id")
