"""Where the copies of species lie in gene trees: neighbourhoods, topology summaries, displacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import leaves


def copy_neighbourhoods(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Species around each copy of a duplicated species: ``tree_id, leaf, species, other, n``.

    The neighbourhood is the largest clade over the copy with at most ``most`` leaves, its parent at
    least; the copy itself is left out. A tree is one row meanwhile, so nodes are shuffled by tree
    once, and what follows by tree stays there.
    """
    tip, node = F.struct(F.col("lo").alias("leaf"), F.col("label").alias("species"), "parent_lo"), F.struct("lo", "hi")
    trees = nodes.groupBy("tree_id").agg(F.collect_list(F.when(F.col("is_leaf"), tip)).alias("tips"), F.sort_array(F.collect_list(F.when(~F.col("is_leaf"), node))).alias("inner"))
    within = lambda u: F.filter("tips", lambda x: x["leaf"].between(u["lo"], u["hi"]))
    copies = F.filter("tips", lambda t: t["parent_lo"].isNotNull() & (F.size(F.filter("tips", lambda x: x["species"] == t["species"])) > 1))
    trees = trees.withColumn("copies", copies).filter(F.size("copies") > 0)
    trees = trees.withColumn("inner", F.transform("inner", lambda u: F.struct(u["lo"].alias("lo"), u["hi"].alias("hi"), F.size(within(u)).alias("size"))))

    def around(t: Column) -> Column:
        over = F.filter("inner", lambda u: t["leaf"].between(u["lo"], u["hi"]) & ((u["lo"] == t["parent_lo"]) | (u["size"] <= most)))
        # inner nodes are in order, so the first is the largest
        near = F.flatten(F.transform(F.slice(over, 1, 1), within))
        return F.struct(t["leaf"].alias("leaf"), t["species"].alias("species"), F.transform(F.filter(near, lambda x: x["leaf"] != t["leaf"]), lambda x: x["species"]).alias("others"))

    rows = trees.select("tree_id", F.inline(F.transform("copies", around)))
    return rows.select("tree_id", "leaf", "species", F.explode("others").alias("other")).groupBy("tree_id", "leaf", "species", "other").agg(F.count("*").alias("n"))


def copy_cluster_support(neighbourhoods: DataFrame, clades: DataFrame, trees: DataFrame, away: float = 0.5) -> DataFrame:
    """How much the away copies of a clade lie among another: ``sample_id, clade, other, total, peak``.

    ``neighbourhoods`` also has ``sample_id``; ``clades`` is ``clade, species`` and ``trees``
    ``sample_id, trees``. A copy of a species of the clade is away if under ``away`` of its
    neighbourhood is of the clade. total: the shares of the other clade in these copies'
    neighbourhoods, over the number of trees; peak: the greatest. Pairs without any are left out.
    A copy is one row with the shares of all clades meanwhile.
    """
    copy = ["sample_id", "tree_id", "leaf", "species"]
    whole = neighbourhoods.groupBy(copy).agg(F.sum("n").alias("size"), F.collect_list(F.struct("other", "n")).alias("near"))
    inside = whole.select(*copy, "size", F.inline("near")).join(clades.select("clade", F.col("species").alias("other")), "other").groupBy(*copy, "size", "clade").agg(F.sum("n").alias("k"))
    shares = inside.groupBy(copy).agg(F.collect_list(F.struct(F.col("clade").alias("other"), (F.col("k") / F.col("size")).alias("share"))).alias("shares"))
    own = shares.join(clades.select("clade", "species"), "species")
    inner = F.get(F.filter("shares", lambda x: x["other"] == F.col("clade")), F.lit(0))["share"]
    met = own.filter(F.coalesce(inner, F.lit(0.0)) < away).select("sample_id", "clade", F.inline("shares"))
    return met.groupBy("sample_id", "clade", "other").agg(F.sum("share").alias("total"), F.max("share").alias("peak")).join(trees, "sample_id").select("sample_id", "clade", "other", (F.col("total") / F.col("trees")).alias("total"), "peak")


def topology_summaries(nodes: DataFrame, clades: DataFrame) -> DataFrame:
    """Three summaries of a sample's gene trees per clade of two or more species: ``sample_id, clade, colocation, monophyly, consistency``.

    ``nodes`` also has ``sample_id``; ``clades`` is ``clade, species``. colocation: in trees with two or
    more duplicated species of the clade, the share of these whose copies lie below different
    children of the clade's last common ancestor. monophyly: first copies over all leaves below their
    last common ancestor, in trees with two or more species. consistency: one less the variation
    coefficient of the depths at which copies meet, 0 at least; 1 for one depth, 0 for none.
    """
    wide = clades.groupBy("clade").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("clade")
    own = clades.join(wide, "clade")
    tree = ["sample_id", "tree_id"]
    tips = nodes.filter("is_leaf").select(*tree, F.col("lo").alias("leaf"), F.col("label").alias("species"))
    inner = nodes.filter("not is_leaf").select(*tree, "lo", "hi", "depth")

    def meeting(spans: DataFrame, keys: list[str]) -> DataFrame:
        """The deepest inner node over each span ``a .. b``."""
        over = spans.join(inner, tree).filter("lo <= a and hi >= b")
        return over.groupBy(*keys, "a", "b").agg(F.max_by(F.struct("lo", "hi", "depth"), "lo").alias("at")).select(*keys, "a", "b", "at.*")

    held = tips.join(own, "species")
    kinds = held.groupBy(*tree, "clade", "species").agg(F.count("*").alias("n"), F.min("leaf").alias("a"), F.max("leaf").alias("b"))
    many = kinds.filter("n > 1")
    several = many.groupBy(*tree, "clade").agg(F.count("*").alias("multi")).filter("multi > 1")
    spans = held.join(several, [*tree, "clade"], "left_semi").groupBy(*tree, "clade").agg(F.min("leaf").alias("a"), F.max("leaf").alias("b"))
    top = meeting(spans, [*tree, "clade"])
    child = nodes.filter("parent_lo is not null").select(*tree, F.col("parent_lo").alias("lo"), F.col("lo").alias("c"), F.col("hi").alias("c_hi"))
    split = top.select(*tree, "clade", "lo").join(child, [*tree, "lo"]).join(held.join(many.select(*tree, "clade", "species"), [*tree, "clade", "species"]), [*tree, "clade"]).filter("leaf between c and c_hi")
    parted = split.groupBy(*tree, "clade", "species").agg(F.count_distinct("c").alias("sides")).groupBy(*tree, "clade").agg(F.count(F.when(F.col("sides") > 1, 1)).alias("apart"))
    colocation = parted.join(several, [*tree, "clade"]).groupBy("sample_id", "clade").agg(F.avg(F.col("apart") / F.col("multi")).alias("colocation"))
    firsts = kinds.groupBy(*tree, "clade").agg(F.count("*").alias("kinds"), F.min("a").alias("a"), F.max("a").alias("b")).filter("kinds > 1")
    under = meeting(firsts, [*tree, "clade", "kinds"]).join(tips.select(*tree, "leaf"), tree).filter("leaf between lo and hi").groupBy(*tree, "clade", "kinds").agg(F.count("*").alias("size"))
    monophyly = under.groupBy("sample_id", "clade").agg(F.avg(F.col("kinds") / F.col("size")).alias("monophyly"))
    depth = F.col("depth").cast("double")
    depths = meeting(many.select(*tree, "clade", "species", "a", "b"), [*tree, "clade", "species"]).groupBy("sample_id", "clade").agg(F.count("*").alias("k"), F.avg(depth).alias("mean"), F.stddev_samp(depth).alias("std"))
    level = F.when(F.col("k") == 1, 1.0).when(F.col("mean") > 0, 1 - F.least(F.try_divide(F.col("std"), F.col("mean")), F.lit(1.0))).otherwise(1.0)
    consistency = depths.select("sample_id", "clade", level.alias("consistency"))
    every = nodes.select("sample_id").distinct().join(wide)
    out = every.join(colocation, ["sample_id", "clade"], "left").join(monophyly, ["sample_id", "clade"], "left").join(consistency, ["sample_id", "clade"], "left")
    return out.na.fill(0.0, ["colocation", "monophyly", "consistency"])


def displacement(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """How far polyploids are from a true place, in edges of the skeleton of diploids: ``tree_id, species, distance, kind``.

    The skeleton is the true tree over the species with one copy there and in the inferred tree, in
    trees with three or more. A copy is anchored where the diploids of the smallest clade over it that
    has any meet in the skeleton; the distance is the least from the first inferred copy's anchor to
    that of a true copy. kind: correct (0), local (up to 2) or long_range.
    """
    count = lambda d: leaves(d).groupBy("tree_id", "species").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"))
    a, b = count(truth), count(inferred)
    single = a.filter("n = 1").select("tree_id", "species", "leaf").join(b.filter("n = 1").select("tree_id", "species"), ["tree_id", "species"])
    enough = single.groupBy("tree_id").agg(F.count("*").alias("k")).filter("k >= 3").select("tree_id")
    bones = single.join(enough, "tree_id")

    def covers(nodes: DataFrame, own: DataFrame) -> DataFrame:
        """Inner nodes with the first and last true leaf of the diploids below and their number."""
        inner = nodes.filter("not is_leaf").select("tree_id", "lo", "hi")
        where = leaves(nodes).select("tree_id", "species", F.col("leaf").alias("x"))
        return inner.join(own.join(where, ["tree_id", "species"]), "tree_id").filter("x between lo and hi").groupBy("tree_id", "lo", "hi").agg(F.min("leaf").alias("first"), F.max("leaf").alias("last"))

    def anchors(nodes: DataFrame) -> DataFrame:
        """Each copy of a polyploid with the span of the diploids nearest to it."""
        copies = leaves(nodes).select("tree_id", "species", "leaf").join(a.filter("n > 1").select("tree_id", "species"), ["tree_id", "species"])
        over = copies.join(covers(nodes, bones), "tree_id").filter("leaf between lo and hi")
        return over.groupBy("tree_id", "species", "leaf").agg(F.max_by(F.struct("first", "last"), "lo").alias("at")).select("tree_id", "species", "leaf", "at.first", "at.last")

    skeleton = covers(truth, bones).select("tree_id", "first", "last").distinct().filter("first < last")
    tips = bones.select("tree_id", F.col("leaf").alias("first"), F.col("leaf").alias("last"))
    joints = skeleton.unionByName(tips)

    def met(spans: DataFrame, keys: list[str]) -> DataFrame:
        """Depth in the skeleton of the joint where each span meets."""
        above = joints.select("tree_id", F.col("first").alias("f"), F.col("last").alias("l"))
        return spans.join(above, "tree_id").filter("f <= first and l >= last").groupBy("tree_id", *keys).agg(F.count("*").alias("depth"))

    start = anchors(inferred).groupBy("tree_id", "species").agg(F.min_by(F.struct("first", "last"), "leaf").alias("s")).select("tree_id", "species", F.col("s.first").alias("f0"), F.col("s.last").alias("l0"))
    pairs = anchors(truth).join(start, ["tree_id", "species"]).select("tree_id", "species", "leaf", "first", "last", "f0", "l0")
    keys = ["species", "leaf"]
    one = met(pairs.select("tree_id", *keys, F.col("f0").alias("first"), F.col("l0").alias("last")), keys).withColumnRenamed("depth", "d0")
    two = met(pairs.select("tree_id", *keys, "first", "last"), keys).withColumnRenamed("depth", "d1")
    top = met(pairs.select("tree_id", *keys, F.least("first", "f0").alias("first"), F.greatest("last", "l0").alias("last")), keys).withColumnRenamed("depth", "d2")
    far = one.join(two, ["tree_id", *keys]).join(top, ["tree_id", *keys])
    least = far.groupBy("tree_id", "species").agg(F.min(F.col("d0") + F.col("d1") - 2 * F.col("d2")).alias("distance"))
    return least.withColumn("kind", F.when(F.col("distance") == 0, "correct").when(F.col("distance") <= 2, "local").otherwise("long_range"))
