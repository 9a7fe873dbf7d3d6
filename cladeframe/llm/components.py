"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``edges(a, b)`` of long node ids.

    Returns ``(node, component)`` for every node that has an edge to another node; component is
    the smallest node id reachable. Self-loops and edges with a null end are ignored. Each round
    aggregates before it joins, so a hub's neighbours are never gathered in one row, and is
    written to the shared folder, so the plan stays short. Only a count and a checksum reach the
    driver.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = cut(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined_away(*classes: DataFrame) -> DataFrame:
    """Ids that are not the smallest of their class once all classes that share a member are one: ``doc_id``.

    Each of ``classes`` is ``doc_id, component_id`` with distinct ids, in the same type. Ids stand for
    each other by 64-bit hashes while components are sought. No class is gathered in one task: members
    are told from the smallest by an anti-join on ids.
    """
    links = classes[0].select("doc_id", "component_id")
    for more in classes[1:]:
        links = links.unionByName(more.select("doc_id", "component_id"))
    links = cut(links.filter("doc_id <> component_id"), "links")
    nodes = cut(connected_components(links.select(F.xxhash64("doc_id").alias("a"), F.xxhash64("component_id").alias("b"))), "joined")
    ids = links.select(F.explode(F.array("doc_id", "component_id")).alias("doc_id")).distinct()
    least = ids.withColumn("node", F.xxhash64("doc_id")).join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("doc_id"))
    return ids.join(least.select("doc_id"), "doc_id", "left_anti")
