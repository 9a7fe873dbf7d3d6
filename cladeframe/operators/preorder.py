"""Structures over preorder: running sums, ranges of leaves, last common ancestors, keyed splits.

Nodes are those of `trees`. Each operator sorts a tree's nodes once and keeps a row per node (twice
that while it walks), however deep the tree: a caterpillar costs what a balanced tree does. Lengths
are summed as decimals with 18 places, so what a walk adds and takes away again leaves nothing; they
must lie under 1e19. A missing length counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def _step() -> Column:
    return F.coalesce(F.col("dist").cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))


def walked(nodes: DataFrame) -> DataFrame:
    """Every node with ``far``, its distance from above the root, and the leaves below it as a range ``first`` to ``last`` of ranks from 0 on.

    A walk enters a node at ``lo`` and leaves it behind ``hi``: lengths are added and taken away, and
    leaves are counted.
    """
    turns = F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("turn")))
    rows = nodes.select("*", F.explode(turns).alias("t")).select(*nodes.columns, F.col("t.at").alias("__at"), F.col("t.turn").alias("__turn"))
    before = W.partitionBy("tree_id").orderBy("__at", "__turn").rowsBetween(W.unboundedPreceding, 0)
    entered = F.col("__turn") == 0
    leaf = (F.col("is_leaf") & entered).cast("long")
    rows = rows.withColumns({"__far": F.sum(F.when(entered, _step()).otherwise(-_step())).over(before), "__leaves": F.sum(leaf).over(before)})
    others = [F.any_value(c).alias(c) for c in nodes.columns if c not in ("tree_id", "lo")]
    found = rows.groupBy("tree_id", "lo").agg(*others, F.max(F.when(entered, F.col("__far"))).alias("far"), F.max(F.when(entered, F.col("__leaves") - leaf)).alias("first"), F.max(F.when(~entered, F.col("__leaves") - 1)).alias("last"))
    return found.select(*nodes.columns, "far", "first", "last")


def _levels(rows: DataFrame, rank: str) -> int:
    """Doublings that reach over the most ranks of a tree."""
    return int(rows.agg(F.max(rank)).first()[0] or 0).bit_length() + 1


def _doubled(rows: DataFrame, value: Column, pick: Callable[..., Column], levels: int, name: str) -> DataFrame:
    """Adds an array: at level k the pick among the values of 2**k rows of a tree from this one on, by ``rank``."""
    by = W.partitionBy("tree_id").orderBy("rank")
    rows = rows.withColumn("__0", value)
    for k in range(1, levels):
        rows = rows.withColumn(f"__{k}", pick(f"__{k - 1}", F.lead(f"__{k - 1}", 1 << (k - 1)).over(by)))
    made = [f"__{k}" for k in range(levels)]
    return rows.withColumn(name, F.array(*made)).drop(*made)


def _level(width: Column) -> Column:
    """The greatest k with 2**k no more than ``width``."""
    return F.length(F.bin(width)) - 1


def with_height(nodes: DataFrame) -> DataFrame:
    """Adds each node's height: how much deeper the deepest leaf below lies; 0 for leaves."""
    rows = cut(walked(nodes), "walked")
    tips = rows.filter("is_leaf").select("tree_id", F.col("first").alias("rank"), F.col("depth").alias("__depth"))
    table = _doubled(tips, F.col("__depth"), F.greatest, _levels(tips, "rank"), "deepest").select("tree_id", "rank", "deepest")
    level = _level(F.col("last") - F.col("first") + 1)
    asked = rows.withColumn("__level", level).withColumn("__then", F.col("last") + 1 - F.pow(F.lit(2), F.col("__level")).cast("long"))
    one = table.select("tree_id", F.col("rank").alias("first"), F.col("deepest").alias("__a"))
    two = table.select("tree_id", F.col("rank").alias("__then"), F.col("deepest").alias("__b"))
    met = asked.join(one, ["tree_id", "first"]).join(two, ["tree_id", "__then"])
    deepest = F.greatest(F.get("__a", F.col("__level")), F.get("__b", F.col("__level")))
    return met.select(*nodes.columns, (deepest - F.col("depth")).alias("height"))


def _met(nodes: DataFrame) -> DataFrame:
    """The nodes in the order of a walk, with ``far`` as in `walked` and for leaves their ``rank`` from 0 on.

    Only the ends of inner nodes are rows beside the nodes, and nothing is joined or grouped.
    """
    own = (F.lit(0).alias("turn"), F.col("lo").alias("at"), F.when(F.col("is_leaf"), 0 * _step()).otherwise(_step()).alias("add"))
    end = (F.lit(1).alias("turn"), F.col("hi").alias("at"), (-_step()).alias("add"))
    turns = F.when(F.col("is_leaf"), F.array(F.struct(*own))).otherwise(F.array(F.struct(*own), F.struct(*end)))
    rows = nodes.select("tree_id", "depth", "is_leaf", "label", "dist", F.explode(turns).alias("t")).select("tree_id", "depth", "is_leaf", "label", "dist", "t.at", "t.turn", "t.add")
    before = W.partitionBy("tree_id").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"far": F.sum("add").over(before), "rank": F.sum(F.col("is_leaf").cast("long")).over(before) - 1}).filter("turn = 0")
    return rows.withColumn("far", F.when(F.col("is_leaf"), F.col("far") + _step()).otherwise(F.col("far"))).drop("turn", "add")


def leaf_index(nodes: DataFrame) -> DataFrame:
    """An index of last common ancestors: per leaf ``tree_id, species, leaf, rank, far, over, under``.

    The last common ancestor of neighbouring leaves is the parent of the node that follows the first
    one in preorder. That of any two is the highest of those between them, so ``over`` keeps the
    highest among 2**k of them from each leaf on, and ``under`` among 2**k up to it, as (depth, far).
    """
    levels = int(nodes.filter("is_leaf").groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0).bit_length() + 1
    by = W.partitionBy("tree_id").orderBy("at")
    gap = F.struct((F.lead("depth").over(by) - 1).alias("depth"), (F.lead("far").over(by) - F.lead(_step()).over(by)).alias("far"))
    tips = _met(nodes).withColumn("__gap", gap).filter("is_leaf")
    rows = tips.withColumn("__0", F.when(F.col("__gap.depth").isNotNull(), F.col("__gap")))
    for k in range(1, levels):
        rows = rows.withColumn(f"__{k}", F.least(f"__{k - 1}", F.lead(f"__{k - 1}", 1 << (k - 1)).over(by)))
    over = F.array(*(F.col(f"__{k}") for k in range(levels)))
    under = F.array(*(F.lag(f"__{k}", 1 << k).over(by) for k in range(levels)))
    return rows.select("tree_id", F.col("label").alias("species"), F.col("at").alias("leaf"), "rank", "far", over.alias("over"), under.alias("under"))


def _leaf() -> Column:
    return F.struct("rank", "leaf", "species", "far", "over", "under")


def pair_distance(x: Column, y: Column) -> Column:
    """The path distance (double) of two leaves of a tree, x before y: structs with ``rank, far, over, under`` of `leaf_index`."""
    level = _level(y["rank"] - x["rank"])
    return (x["far"] + y["far"] - 2 * F.least(F.get(x["over"], level), F.get(y["under"], level))["far"]).cast("double")


def tip_distances(nodes: DataFrame) -> DataFrame:
    """Distance of each leaf from the root, the root's own length included: ``tree_id, leaf, species, distance``."""
    return _met(nodes).filter("is_leaf").select("tree_id", F.col("at").alias("leaf"), F.col("label").alias("species"), F.col("far").cast("double").alias("distance"))


def copy_pairs(nodes: DataFrame) -> DataFrame:
    """Path distance between each two copies of a species in a tree: ``tree_id, species, x, y, distance``.

    The copies of a species in a tree are one array meanwhile; each meets those behind it.
    """
    copies = leaf_index(nodes).groupBy("tree_id", "species").agg(F.sort_array(F.collect_list(_leaf())).alias("all")).filter(F.size("all") > 1)
    one = copies.select("tree_id", "species", "all", F.posexplode("all").alias("at", "x")).select("tree_id", "species", "x", F.slice("all", F.col("at") + 2, F.size("all")).alias("rest"))
    two = one.select("tree_id", "species", "x", F.explode("rest").alias("y"))
    return two.select("tree_id", "species", F.col("x.leaf").alias("x"), F.col("y.leaf").alias("y"), pair_distance(F.col("x"), F.col("y")).alias("distance"))


def nearest_species(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Distance from the copies of a species to the nearest leaf of every other one, per tree: ``tree_id, species, other, distance``.

    ``asked`` is ``tree_id, species``: the species whose copies are looked at. Each copy meets the
    leaves of its tree once, which are one array meanwhile; the least distance per pair of species is left.
    """
    wanted = asked.groupBy("tree_id").agg(F.collect_set("species").alias("wanted"))
    trees = leaf_index(nodes).groupBy("tree_id").agg(F.collect_list(_leaf()).alias("all")).join(wanted, "tree_id")
    own = trees.select("tree_id", "all", F.explode(F.filter("all", lambda x: F.array_contains("wanted", x["species"]))).alias("a"))
    met = own.select("tree_id", "a", F.explode("all").alias("b")).filter("a.species <> b.species")
    a, b = F.col("a"), F.col("b")
    far = F.when(a["rank"] < b["rank"], pair_distance(a, b)).otherwise(pair_distance(b, a))
    return met.select("tree_id", a["species"].alias("species"), b["species"].alias("other"), far.alias("distance")).groupBy("tree_id", "species", "other").agg(F.min("distance").alias("distance"))


def ultrametric_lengths(nodes: DataFrame, height: float = 1_000_000.0) -> DataFrame:
    """Lengths from the topology alone: all tips at ``height``, inner nodes in proportion to their own heights.

    A node lies at ``height * (top - own) / top`` with the heights of `with_height` (top: the root's), and
    a branch is the difference to its parent's place. A tip's branch ends at ``height``. The root has
    no branch; a tree of one node stays as it is. Polytomies are kept.
    """
    rows = cut(with_height(nodes), "heights")
    tall = rows.filter("parent_lo is null").select("tree_id", F.col("height").alias("__top"))
    place = F.when(F.col("is_leaf"), F.lit(height)).otherwise(F.lit(height) * (F.col("__top") - F.col("height")) / F.col("__top"))
    placed = rows.join(tall, "tree_id").withColumn("__place", place)
    up = placed.select("tree_id", F.col("lo").alias("parent_lo"), F.col("__place").alias("__above"))
    own = F.when(F.col("__top") == 0, F.col("dist")).when(F.col("parent_lo").isNull(), F.lit(None)).otherwise(F.round(F.col("__place") - F.col("__above"), 12))
    return placed.join(up, ["tree_id", "parent_lo"], "left").withColumn("dist", own).select(nodes.columns)


def split_keys(nodes: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Unrooted splits of trees with one leaf per species as numbers: ``tree_id, side``, a struct of two longs.

    A species is a random number of 128 bits, the same in every tree; a node is the exclusive or of the
    leaves below, the difference of two running ones; the lesser of that and of the rest's stands for
    both sides. With ``kept`` (``tree_id, species``) the trees are first pruned: other leaves count as
    zero, and nodes that then hold the same leaves are one. Splits with a side of fewer than two
    leaves are left out, and so are trees in which a kept species has two leaves. Two splits of
    different species meet by chance only (1 in 2**128 a pair).
    """
    if kept is None:
        marked = nodes.withColumn("__in", F.col("is_leaf"))
    else:
        names = kept.select("tree_id", F.col("species").alias("label")).distinct().withColumn("__kept", F.lit(True))
        marked = nodes.join(names, ["tree_id", "label"], "left").withColumn("__in", F.col("is_leaf") & F.coalesce("__kept", F.lit(False)))
    turns = F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("turn")))
    rows = marked.select("tree_id", "lo", "label", "__in", F.explode(turns).alias("t")).select("tree_id", "lo", "label", "t.at", "t.turn", (F.col("__in") & (F.col("t.turn") == 0)).alias("leaf"))
    key = lambda seed: F.when(F.col("leaf"), F.xxhash64("label", F.lit(seed))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"k1": key("one"), "k2": key("two"), "n": F.col("leaf").cast("long")})
    before = W.partitionBy("tree_id").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("tree_id", "lo", "turn", "label", "leaf", *(f(c).over(before).alias(f"r_{c}") for f, c in ((F.bit_xor, "k1"), (F.bit_xor, "k2"), (F.sum, "n"))), "k1", "k2", "n")
    open_, shut = F.col("turn") == 0, F.col("turn") == 1
    xor = lambda c: F.max(F.when(shut, F.col(f"r_{c}"))).bitwiseXOR(F.max(F.when(open_, F.col(f"r_{c}").bitwiseXOR(F.col(c)))))
    found = rows.groupBy("tree_id", "lo").agg(xor("k1").alias("k1"), xor("k2").alias("k2"), (F.max(F.when(shut, F.col("r_n"))) - F.max(F.when(open_, F.col("r_n") - F.col("n")))).alias("n"))
    leaves = rows.filter("leaf").groupBy("tree_id").agg(F.bit_xor("k1").alias("t1"), F.bit_xor("k2").alias("t2"), F.count("*").alias("all"), F.count_distinct("label").alias("kinds")).filter(F.col("all") == F.col("kinds"))
    one = F.struct(F.col("k1").alias("a"), F.col("k2").alias("b"))
    rest = F.struct(F.col("k1").bitwiseXOR(F.col("t1")).alias("a"), F.col("k2").bitwiseXOR(F.col("t2")).alias("b"))
    return found.join(leaves, "tree_id").filter((F.col("n") > 1) & (F.col("all") - F.col("n") > 1)).select("tree_id", F.least(one, rest).alias("side")).distinct()


def split_distances(trees: DataFrame, reference: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Robinson-Foulds distance of each tree to the reference of the same ``tree_id``: ``tree_id, rf, normalised``.

    Both are nodes, pruned to ``kept`` as in `split_keys`. Normalised is over the splits of both, and 0
    where neither has any. Trees that are on one side only, that repeat a kept species, or whose
    kept species differ are left out.
    """

    def single(nodes: DataFrame) -> DataFrame:
        tips = nodes.filter("is_leaf").select("tree_id", F.col("label").alias("species"))
        tips = tips if kept is None else tips.join(kept.select("tree_id", "species").distinct(), ["tree_id", "species"], "left_semi")
        per = tips.groupBy("tree_id").agg(F.count("*").alias("all"), F.count_distinct("species").alias("kinds"), F.bit_xor(F.xxhash64("species")).alias("species"))
        return per.filter(F.col("all") == F.col("kinds")).select("tree_id", "species")

    pairs = single(trees).join(single(reference), ["tree_id", "species"]).select("tree_id")
    sides = split_keys(trees, kept).withColumn("x", F.lit(1)).unionByName(split_keys(reference, kept).withColumn("x", F.lit(0)))
    met = sides.groupBy("tree_id", "side").agg(F.count("*").alias("n")).groupBy("tree_id").agg(F.sum("n").alias("all"), F.count(F.when(F.col("n") == 1, 1)).alias("rf"))
    rf = F.coalesce("rf", F.lit(0).cast("long"))
    return pairs.join(met, "tree_id", "left").select("tree_id", rf.alias("rf"), F.coalesce(F.try_divide(rf, F.col("all")), F.lit(0.0)).alias("normalised"))
