"""Backbones compared tree by tree against `split_distances`, and that no node moves for it."""

import random

from pyspark.sql import functions as F

from cladeframe.operators import backbones as B
from cladeframe.operators import lineage
from cladeframe.operators import trees as T
from cladeframe.operators.preorder import split_distances


def text(rng, names):
    parts = list(names)
    rng.shuffle(parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [f"({','.join(parts[i : i + 2])})"]
    return parts[0] + ";"


def test_errors_are_split_distances(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for i in range(80):
        names = rng.choices("abcdefghij", k=rng.randrange(1, 5)) if i % 4 == 0 else rng.sample("abcdefghij", rng.randrange(1, 10))
        rows.append((i, text(rng, names), text(rng, names if i % 5 else names[1:] or ["k"])))
    side = lambda k: T.parse_newick(spark.createDataFrame([(r[0], r[k]) for r in rows], "tree_id long, newick string")).persist()
    truth, inferred = side(1), side(2)
    diploids = spark.createDataFrame([(x,) for x in "acdegh"], "species string")
    tips = truth.filter("is_leaf").select("tree_id", F.col("label").alias("species")).join(diploids, "species", "left_semi")
    kept = tips.join(tips.groupBy("tree_id").agg(F.count_distinct("species").alias("n")).filter("n > 2"), "tree_id").select("tree_id", "species")
    pruned = split_distances(inferred, truth, kept).select("tree_id", F.col("rf").alias("p"), F.col("normalised").alias("pn"))
    want = split_distances(inferred, truth).join(pruned, "tree_id").join(kept.select("tree_id").distinct(), "tree_id")
    key = lambda d: sorted((r[0], r[1], round(r[2], 9), r[3], round(r[4], 9)) for r in d.collect())

    def written(*_):
        raise AssertionError("a table is written")

    want = key(want)
    monkeypatch.setattr(lineage, "cut", written)
    monkeypatch.setattr(B, "cut", written, raising=False)
    got = B.backbone_errors(inferred, truth, diploids)
    assert len(want) > 15 and key(got) == want
    by_tree = spark.createDataFrame(truth.collect(), truth.schema).repartition(5, "tree_id")
    plan = B.backbone_errors(by_tree, by_tree, F.broadcast(diploids))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tree_id") == plan.count("REPARTITION_BY_NUM") == 2
