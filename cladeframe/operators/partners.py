"""Ranking of a species' candidate partners by four scorers, and what stands in the true partner's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import coclustering, copies_per_tree, copy_contrast
from .preorder import nearest_species

SCORERS = ("coclustering", "contrast", "distance", "rank_sum")


def _tips(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_leaf").select("sample_id", "tree_id", F.col("label").alias("species"), "parent_lo")


def _placed(scores: DataFrame, scorer: str, order: Column) -> DataFrame:
    """Positions from 1 on by the order, then by name; ``shared`` is the same for candidates that tie."""
    own = W.partitionBy("sample_id", "species")
    return scores.select(F.lit(scorer).alias("scorer"), "sample_id", "species", "partner", F.rank().over(own.orderBy(order)).alias("shared"), F.row_number().over(own.orderBy(order, "partner")).alias("position"))


def mean_distances(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Mean over a sample's trees of the distance from a species' copies to the nearest leaf of another: ``sample_id, species, partner, distance``.

    ``asked`` is ``sample_id, species``. Trees without one of the two are left out of a pair's mean.
    """
    trees = nodes.select("sample_id", "tree_id").distinct().join(asked.select("sample_id", "species").distinct(), "sample_id")
    near = nearest_species(nodes, trees.select("tree_id", "species"))
    of = nodes.select("sample_id", "tree_id").distinct()
    return near.join(of, "tree_id").groupBy("sample_id", "species", F.col("other").alias("partner")).agg(F.avg("distance").alias("distance"))


def candidate_positions(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Where each scorer puts each candidate partner of a species: ``scorer, sample_id, species, partner, position``.

    ``nodes`` also has ``sample_id``; ``asked`` is ``sample_id, species``. `coclustering` ranks by the share of trees
    in which two species are direct sisters, `contrast` by how much larger that share is where the
    species is duplicated, `distance` by `mean_distances`, the least first, and `rank_sum` by the sum of the shared
    ranks of co-clustering and distance, over those of the two that list a candidate. A scorer
    lists only candidates that it has seen. Scores are held against each other at 9 places, so the
    order of addition breaks no ties; ties go by name.
    """
    asked = asked.select("sample_id", "species").distinct()
    leaves = _tips(nodes)
    keys = ["sample_id", "species"]
    shares = coclustering(leaves).join(asked, keys, "left_semi")
    contrast = copy_contrast(leaves).join(asked, keys, "left_semi")
    single = _placed(shares, "coclustering", F.round("share", 9).desc()).unionByName(_placed(mean_distances(nodes, asked), "distance", F.round("distance", 9).asc()))
    summed = single.groupBy("sample_id", "species", "partner").agg(F.sum("shared").alias("sum"))
    every = single.unionByName(_placed(contrast, "contrast", F.round("share", 9).desc())).unionByName(_placed(summed, "rank_sum", F.col("sum").asc()))
    return every.drop("shared")


def partner_recovery(positions: DataFrame, events: DataFrame, k: int = 3) -> DataFrame:
    """How often events' true partners are among the first 1 to k candidates: ``scorer, sample_id, n, listed, top1 .. topk``.

    ``events`` is ``sample_id, species, partner``, a row an event. The shares are of the events whose partner the
    scorer lists at all, 0 where it lists none; ``n`` counts all.
    """
    scorers = events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SCORERS))).alias("scorer"))
    rows = events.crossJoin(F.broadcast(scorers)).join(positions, ["scorer", "sample_id", "species", "partner"], "left")
    top = [F.coalesce(F.avg(F.when(F.col("position").isNotNull(), (F.col("position") <= i).cast("double"))), F.lit(0.0)).alias(f"top{i}") for i in range(1, k + 1)]
    return rows.groupBy("scorer", "sample_id").agg(F.count("*").alias("n"), F.count("position").alias("listed"), *top)


def confusers(nodes: DataFrame, events: DataFrame, polyploid: float = 1.5, relative: float = 0.2) -> DataFrame:
    """What co-clustering puts first for the events of a sample: ``sample_id, kind, n, of_others, relatives, mean_share``.

    ``kind`` is ``none`` (no candidate), ``partner`` (the true one), else by the mean copies of what stands in its
    place over all trees of the sample: ``polyploid`` from the bound on, or ``diploid``. ``of_others`` counts those that are the true
    partner of an event of the sample, ``relatives`` those that are direct sisters of the true partner
    in at least the share ``relative`` of trees, ``mean_share`` is the mean of these shares; 0 or null for the first two kinds.
    """
    leaves = _tips(nodes)
    matrix = coclustering(leaves)
    own = W.partitionBy("sample_id", "species").orderBy(F.round("share", 9).desc(), "partner")
    first = matrix.withColumn("k", F.row_number().over(own)).filter("k = 1").select("sample_id", "species", F.col("partner").alias("met"))
    total = leaves.groupBy("sample_id").agg(F.count_distinct("tree_id").alias("trees"))
    mean = copies_per_tree(leaves).groupBy("sample_id", "species").agg(F.sum("n").alias("n")).join(total, "sample_id").select("sample_id", F.col("species").alias("met"), (F.col("n") / F.col("trees")).alias("copies"))
    theirs = events.select("sample_id", F.col("partner").alias("met"), F.lit(1).alias("theirs")).distinct()
    beside = matrix.select("sample_id", F.col("species").alias("met"), "partner", "share")
    rows = events.join(first, ["sample_id", "species"], "left").join(mean, ["sample_id", "met"], "left").join(theirs, ["sample_id", "met"], "left").join(beside, ["sample_id", "met", "partner"], "left")
    wrong = F.col("met") != F.col("partner")
    share = F.when(wrong, F.coalesce("share", F.lit(0.0)))
    kind = F.when(F.col("met").isNull(), "none").when(~wrong, "partner").when(F.col("copies") >= polyploid, "polyploid").otherwise("diploid")
    return rows.groupBy("sample_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(wrong, F.col("theirs"))).alias("of_others"), F.count(F.when(share >= relative, 1)).alias("relatives"), F.avg(share).alias("mean_share"))
