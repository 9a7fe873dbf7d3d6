"""How wrong inferred backbones are, with polyploids and without, and what that costs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summaries import correlation

#: Upper bounds of normalised distances.
BUCKETS = (0.0, 0.05, 0.1, 0.2, 1.0)


def backbone_errors(trees: DataFrame, reference: DataFrame, diploids: DataFrame, least: int = 3) -> DataFrame:
    """Robinson-Foulds distances of inferred trees to the true ones, whole and pruned to diploids: ``tree_id, rf, normalised, pruned_rf, pruned_normalised``.

    ``trees`` and ``reference`` are nodes with equal tree ids, ``diploids`` is ``species``. Trees with fewer than ``least`` diploids, or
    that can't be compared (see `split_distances`), are left out. A tree is one row from the start, and those left out go before any
    is compared, so nodes are shuffled by tree alone and nothing is written.
    """
    named = diploids.select(F.col("species").alias("label"), F.lit(True).alias("kept")).distinct()

    def single(nodes: DataFrame, name: str, enough: int) -> DataFrame:
        """Trees with one leaf per species, and at least so many diploids, as texts."""
        node = F.struct("lo", "depth", "is_leaf", "label", (F.col("is_leaf") & F.col("kept").isNotNull()).alias("kept"))
        trees = nodes.join(named, "label", "left").groupBy("tree_id").agg(F.sort_array(F.collect_list(node)).alias("n"))
        species = F.transform(F.filter("n", lambda x: x["is_leaf"]), lambda x: x["label"])
        good = (F.size(species) == F.size(F.array_distinct(F.array_compact(species)))) & (F.size(F.filter("n", lambda x: x["kept"])) >= enough)
        text = F.to_json(F.struct(F.col("n.depth").alias("d"), F.transform("n", lambda x: F.when(x["is_leaf"], x["label"])).alias("l"), F.col("n.kept").alias("k")))
        return trees.filter(good).select("tree_id", text.alias(name))

    pairs = single(reference, "a", least).join(single(trees, "b", 0), "tree_id")
    rows = pairs.mapInArrow(_distances, pairs.select("tree_id", F.lit(None).cast("array<double>").alias("values")).schema).filter("values is not null")
    v = lambda i, c: F.get("values", F.lit(i)).cast("long" if i % 2 == 0 else "double").alias(c)
    return rows.select("tree_id", *(v(i, c) for i, c in enumerate(("rf", "normalised", "pruned_rf", "pruned_normalised"))))


@lru_cache(4096)
def _key(species: str) -> int:
    """A number of 128 bits, as in `split_keys`."""
    return int.from_bytes(blake2b(species.encode(), digest_size=16).digest())


def _splits(depth: list[int], keys: list[int]) -> set[int]:
    """Unrooted splits of a tree in preorder with the keys of its leaves that count (0 elsewhere); see `split_keys`."""
    n, sums, held, path = len(depth), list(keys), [int(k != 0) for k in keys], []
    found = []
    for i in range(n + 1):
        while path and (i == n or depth[path[-1]] >= depth[i]):
            done = path.pop()
            if path:
                sums[path[-1]] ^= sums[done]
                held[path[-1]] += held[done]
            found.append(done)
        path.append(i)
    whole, every = sums[0], held[0]
    return {min(sums[i], sums[i] ^ whole) for i in found if 1 < held[i] < every - 1}


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of pairs of trees ``a, b``, whole and pruned to what ``a`` keeps; null where the species differ."""
    for batch in batches:
        out = []
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = json.loads(a), json.loads(b)
            names = {x for x in a["l"] if x is not None}
            if names != {x for x in b["l"] if x is not None}:
                out.append(None)
                continue
            row = []
            for of in (names, {x for x, k in zip(a["l"], a["k"]) if k}):
                x, y = (_splits(t["d"], [_key(s) if s in of else 0 for s in t["l"]]) for t in (a, b))
                rf, every = len(x ^ y), len(x) + len(y)
                row += [rf, rf / every if every else 0.0]
            out.append(row)
        yield pa.RecordBatch.from_arrays([batch["tree_id"], pa.array(out, pa.list_(pa.float64()))], names=["tree_id", "values"])


def backbone_summary(errors: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per group the mean and median distance, and the share of trees that are exactly right, whole (``full_``) and pruned (``pruned_``), and by how much pruning helps."""
    measures = [agg for name, rf, d in (("full", "rf", "normalised"), ("pruned", "pruned_rf", "pruned_normalised")) for agg in (F.avg(d).alias(f"{name}_mean"), F.median(d).alias(f"{name}_median"), F.avg((F.col(rf) == 0).cast("double")).alias(f"{name}_exact"))]
    return errors.groupBy(*by).agg(F.count("*").alias("n"), *measures).withColumn("gain", F.col("full_mean") - F.col("pruned_mean"))


def backbone_buckets(scores: DataFrame, bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """Score gaps by how wrong the backbone is: ``bucket, n, mean_gap, median_gap, r``.

    ``scores`` is ``normalised, gap``. A bucket holds what is over the bound before and no more than its own, and is named by it; ``all``
    holds all rows, with the correlation r of the two (null in the buckets and where either does not vary).
    """
    bucket = F.lit("over")
    for bound in reversed(bounds):
        bucket = F.when(F.col("normalised") <= bound, f"<= {bound:g}").otherwise(bucket)
    agg = (F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"))
    per = scores.groupBy(bucket.alias("bucket")).agg(*agg).withColumn("r", F.lit(None).cast("double"))
    whole = scores.agg(*agg, correlation(F.col("normalised"), F.col("gap")).alias("r")).select(F.lit("all").alias("bucket"), "n", "mean_gap", "median_gap", "r")
    return per.unionByName(whole)


def three_way(scores: DataFrame) -> DataFrame:
    """Mean scores on inferred, rerooted and true backbones, over all samples, those with the right topology and the others: ``topology, n, inferred, rerooted, true, closed``.

    ``scores`` is ``rf, inferred, rerooted, true``; ``closed`` is the share of the way from inferred to true that rerooting
    goes, null where there is none to go.
    """
    kind = F.when(F.col("rf") == 0, "exact").otherwise("wrong")
    rows = scores.withColumn("topology", F.explode(F.array(F.lit("all"), kind)))
    means = rows.groupBy("topology").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("inferred", "rerooted", "true")))
    way = F.col("inferred") - F.col("true")
    return means.withColumn("closed", F.when(way > 1e-9, (F.col("inferred") - F.col("rerooted")) / way))
