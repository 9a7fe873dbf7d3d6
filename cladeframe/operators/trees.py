"""Operators on trees kept as rows.

``nodes`` has ``tree_id, lo, hi, depth, parent_lo, is_leaf, label, dist``: nodes numbered in preorder,
``hi`` the last number below. A node holds another if its interval does, so clades and ancestors
are joins on the tree with a range beside, never products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut
from .preorder import copy_pairs, tip_distances, ultrametric_lengths, walked, with_height  # noqa: F401  part of this module's operators

TOKEN = r"[(),]|:[^(),:;]+|[^(),:;\s][^(),:;]*"


def parse_newick(corpus: DataFrame) -> DataFrame:
    """Node table of Newick texts ``tree_id, newick``.

    Tokens are numbered by position; a running count of brackets gives the level, and each opening
    bracket meets its closing one as the next bracket of its level. No recursion and no Python.
    """
    tokens = corpus.select("tree_id", F.posexplode(F.regexp_extract_all("newick", F.lit(f"({TOKEN})"), 1)).alias("at", "token"))
    by = W.partitionBy("tree_id").orderBy("at")
    open_, close = F.col("token") == "(", F.col("token") == ")"
    tokens = tokens.withColumns({"before": F.lag("token").over(by), "next": F.lead("token").over(by), "next2": F.lead("token", 2).over(by), "opened": F.sum(F.when(open_, 1).when(close, -1).otherwise(0)).over(by)})
    length = lambda c: F.col(c).startswith(":")
    leaf = ~F.col("token").isin("(", ")", ",") & ~length("token") & (F.col("before").isNull() | (F.col("before") != ")"))
    tokens = tokens.withColumn("leaf", leaf).withColumn("level", F.when(open_, F.col("opened") - 1).otherwise(F.col("opened")))
    started = F.sum((open_ | F.col("leaf")).cast("long")).over(by)
    tokens = tokens.withColumn("lo", started - 1)
    level = W.partitionBy("tree_id", "level").orderBy("at")
    brackets = tokens.filter(open_ | close)
    number = lambda c: F.col(c).substr(F.lit(2), F.length(c)).cast("double")
    name = F.when(~length("next") & ~F.col("next").isin("(", ")", ","), F.col("next"))
    dist = F.when(length("next"), number("next")).when(name.isNotNull() & length("next2"), number("next2"))
    ends = brackets.withColumns({"label": name, "dist": dist})
    inner = ends.withColumns({"hi": F.lead("lo").over(level), "label": F.lead("label").over(level), "dist": F.lead("dist").over(level)}).filter(open_)
    leaves = tokens.filter("leaf").withColumns({"hi": F.col("lo"), "label": F.col("token"), "dist": F.when(length("next"), number("next"))})
    columns = ["tree_id", "lo", "hi", F.col("level").alias("depth"), F.col("leaf").alias("is_leaf"), "label", "dist"]
    found = inner.select(columns).unionByName(leaves.select(columns))
    # a node is the child of the last opened one a level up
    at = F.explode(F.when(F.col("is_leaf"), F.array(F.col("depth") - 1)).otherwise(F.array(F.col("depth") - 1, "depth"))).alias("key")
    keyed = found.select("*", at)
    opener = F.last(F.when(F.col("key") == F.col("depth"), F.col("lo")), True).over(W.partitionBy("tree_id", "key").orderBy("lo"))
    return keyed.withColumn("parent_lo", opener).filter("key = depth - 1").select("tree_id", "lo", "hi", "depth", "parent_lo", "is_leaf", "label", "dist")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_leaf").select("tree_id", F.col("lo").alias("leaf"), F.col("label").alias("species"), "depth", "parent_lo", "dist")


def below(nodes: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """Each inner node with each leaf below: equal trees, the leaf in the node's interval."""
    n = nodes.filter("not is_leaf").select("tree_id", "lo", "hi", F.col("depth").alias("node_depth"))
    return n.join(leaf_rows, "tree_id").filter("leaf between lo and hi")


def clade_members(nodes: DataFrame) -> DataFrame:
    """Species below every inner node: ``tree_id, lo, species`` without repeats."""
    return below(nodes, leaves(nodes)).select("tree_id", "lo", "species").distinct()


def species_multisets(nodes: DataFrame) -> DataFrame:
    """Sorted ``(species, n)`` array of every inner node."""
    counts = below(nodes, leaves(nodes)).groupBy("tree_id", "lo", "species").agg(F.count("*").alias("n"))
    return counts.groupBy("tree_id", "lo").agg(F.sort_array(F.collect_list(F.struct("species", "n"))).alias("multiset"))


def tree_heights(nodes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Mean and greatest tip distance per tree, and whether all tips are as far within ``tolerance``."""
    d = F.col("distance")
    return tip_distances(nodes).groupBy("tree_id").agg(F.avg(d).alias("mean_height"), F.max(d).alias("height"), (F.max(d) - F.min(d) <= tolerance).alias("ultrametric"))


def rescale_to_height(nodes: DataFrame, height: float = 1.0) -> DataFrame:
    """Branch lengths multiplied so that the farthest tip of each tree lies at ``height``; trees without length stay."""
    tall = tree_heights(nodes).select("tree_id", F.col("height").alias("tall"))
    return nodes.join(tall, "tree_id", "left").withColumn("dist", F.when(F.col("tall") > 0, F.col("dist") / F.col("tall") * height).otherwise(F.col("dist"))).drop("tall")


def sister_species(nodes: DataFrame) -> DataFrame:
    """Pairs of species that are leaves of one parent, once per tree, smaller name first."""
    own = leaves(nodes).select("tree_id", "parent_lo", "species").distinct()
    a, b = own.withColumnRenamed("species", "a"), own.withColumnRenamed("species", "b")
    return a.join(b, ["tree_id", "parent_lo"]).filter("a < b").select("tree_id", "a", "b").distinct()


def copy_distances(nodes: DataFrame) -> DataFrame:
    """Least path distance between two copies of a species in a tree."""
    return copy_pairs(nodes).groupBy("tree_id", "species").agg(F.min("distance").alias("distance"))


def mirrored_nodes(nodes: DataFrame) -> DataFrame:
    """Binary nodes whose children hold the same set of species: ``tree_id, lo``."""
    return mirrored_sets(species_sets(nodes))


def mirrored_sets(sets: DataFrame) -> DataFrame:
    """`mirrored_nodes` from `species_sets` at hand."""
    return sets.filter("parent_lo is not null").groupBy("tree_id", "parent_lo").agg(F.count("*").alias("children"), F.min("set").alias("a"), F.max("set").alias("b")).filter("children = 2 and a = b").select("tree_id", F.col("parent_lo").alias("lo"))


def species_sets(nodes: DataFrame) -> DataFrame:
    """Every node with its sorted set of species."""
    inner = below(nodes, leaves(nodes)).groupBy("tree_id", "lo").agg(F.sort_array(F.collect_set("species")).alias("set"))
    return nodes.join(inner, ["tree_id", "lo"], "left").withColumn("set", F.coalesce("set", F.array("label"))).select("tree_id", "lo", "parent_lo", "set")


def basal_splits(nodes: DataFrame) -> DataFrame:
    """The smaller side of each tree's root (fewer leaves; then the set that sorts first)."""
    sides = nodes.filter("depth = 1").select("tree_id", "lo", "hi")
    held = sides.join(leaves(nodes).select("tree_id", "leaf", "species"), "tree_id").filter("leaf between lo and hi").groupBy("tree_id", "lo").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("species")).alias("side"))
    return held.groupBy("tree_id").agg(F.min(F.struct("n", "side"))["side"].alias("side"))


def consensus_split(splits: DataFrame) -> DataFrame:
    """The side met in most trees (the one that sorts first on ties)."""
    return splits.groupBy("side").agg(F.count("*").alias("trees")).orderBy(F.desc("trees"), "side").limit(1)


def basal_frequencies(splits: DataFrame, species: DataFrame) -> DataFrame:
    """How often each species lies on the smaller side of the root: ``sample_id, species, basal, trees, frequency``.

    ``splits`` is ``sample_id, tree_id, side`` (see `basal_splits`), ``species`` ``sample_id, species``: those that are never basal have 0.
    """
    trees = splits.groupBy("sample_id").agg(F.count("*").alias("trees"))
    met = splits.select("sample_id", F.explode("side").alias("species")).groupBy("sample_id", "species").agg(F.count("*").alias("basal"))
    every = species.select("sample_id", "species").distinct().join(trees, "sample_id").join(met, ["sample_id", "species"], "left").na.fill(0, ["basal"])
    return every.select("sample_id", "species", "basal", "trees", (F.col("basal") / F.col("trees")).alias("frequency"))


def basal_clades(frequencies: DataFrame, clades: DataFrame) -> DataFrame:
    """The clade of each sample whose species are basal most often above the mean of all (the first by name on ties): ``sample_id, clade, excess``.

    ``clades`` is ``clade, species``; clades that hold all of a sample's species are left out. Excesses are compared at 9 places.
    """
    whole = frequencies.groupBy("sample_id").agg(F.avg("frequency").alias("overall"), F.count("*").alias("all"))
    inside = frequencies.join(clades.select("clade", "species").distinct(), "species").groupBy("sample_id", "clade").agg(F.avg("frequency").alias("inside"), F.count("*").alias("n"))
    over = inside.join(whole, "sample_id").filter(F.col("n") < F.col("all")).withColumn("excess", F.round(F.col("inside") - F.col("overall"), 9))
    return over.groupBy("sample_id").agg(F.min_by(F.struct("clade", "excess"), F.struct(-F.col("excess"), "clade")).alias("b")).select("sample_id", "b.*")


def levels(nodes: DataFrame, max_height: int | None = None) -> int:
    """Levels of inner nodes: ``max_height``, which no node may lie below, or the greatest depth."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    if max_height is not None and deepest > max_height:
        raise ValueError(f"nodes at depth {deepest}, below max_height={max_height}")
    return deepest if max_height is None else max_height


def canonical_codes(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """A code per node, equal exactly for subtrees that are alike up to the order of children: ``tree_id, lo, parent_lo, depth, code``."""
    return coded(nodes, max_height).select("tree_id", "lo", "parent_lo", "depth", "code")


def coded(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """`canonical_codes` with the nodes' ``hi, is_leaf, label`` kept, and ``tip``, the depth of the deepest leaf below.

    A tree's nodes are met in postorder, each once all below it have been: what is open then and lies
    deeper are its children, whose sorted codes are hashed to its own. So the depth of trees costs no
    rounds, and nodes are shuffled once, by tree; a tree is one array meanwhile.
    """
    if max_height is not None:
        levels(nodes, max_height)
    columns = ("depth", "parent_lo", "is_leaf", "label")
    at = F.struct("hi", (-F.col("lo")).alias("back"), "lo", *columns)
    trees = nodes.groupBy("tree_id").agg(F.sort_array(F.collect_list(at)).alias("nodes"))
    none = lambda of: F.array().cast(f"array<struct<{of}>>")
    depth, lo = nodes.schema["depth"].dataType.simpleString(), nodes.schema["lo"].dataType.simpleString()

    def step(state, node):
        children = F.filter(state["open"], lambda x: x["depth"] > node["depth"])
        code = F.when(node["is_leaf"], F.sha2(node["label"], 256)).otherwise(F.sha2(F.concat_ws(",", F.sort_array(F.transform(children, lambda x: x["code"]))), 256))
        tip = F.when(node["is_leaf"], node["depth"]).otherwise(F.array_max(F.transform(children, lambda x: x["tip"])))
        rest = F.filter(state["open"], lambda x: x["depth"] <= node["depth"])
        open_ = F.concat(rest, F.array(F.struct(node["depth"].alias("depth"), code.alias("code"), tip.alias("tip"))))
        return F.struct(open_.alias("open"), F.concat(state["codes"], F.array(F.struct(node["lo"].alias("lo"), code.alias("code"), tip.alias("tip")))).alias("codes"))

    first = F.struct(none(f"depth:{depth},code:string,tip:{depth}").alias("open"), none(f"lo:{lo},code:string,tip:{depth}").alias("codes"))
    codes = F.aggregate("nodes", first, step, lambda s: s["codes"])
    row = F.explode(F.arrays_zip(F.col("nodes"), F.col("codes"))).alias("r")
    return trees.select("tree_id", "nodes", codes.alias("codes")).select("tree_id", row).select("tree_id", "r.nodes.lo", "r.nodes.hi", *(f"r.nodes.{c}" for c in columns), "r.codes.code", "r.codes.tip")


def collapse_identical(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """Trees alike up to the order of children: the smallest tree_id of each kind and how many there are."""
    roots = canonical_codes(nodes, max_height).filter("parent_lo is null")
    return roots.groupBy("code").agg(F.min("tree_id").alias("tree_id"), F.count("*").alias("n_trees")).drop("code")


def single_species_clades(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Largest clades of one species with at least ``least`` copies, and the leaf that stands for each."""
    pure = below(nodes, leaves(nodes)).groupBy("tree_id", "lo", "hi").agg(F.count_distinct("species").alias("kinds"), F.count("*").alias("copies"), F.min("species").alias("species"), F.min("leaf").alias("kept")).filter((F.col("kinds") == 1) & (F.col("copies") >= least))
    parents = nodes.select("tree_id", "lo", "parent_lo")
    inside = pure.join(parents, ["tree_id", "lo"]).join(pure.select("tree_id", F.col("lo").alias("parent_lo")), ["tree_id", "parent_lo"], "left_anti")
    return inside.select("tree_id", "lo", "species", "copies", "kept")


def sibling_sets(nodes: DataFrame) -> DataFrame:
    """Per node with siblings: the species of its parent that are not only its own."""
    sets = species_sets(nodes)
    parent = sets.select("tree_id", F.col("lo").alias("parent_lo"), F.col("set").alias("parent_set"))
    return sets.join(parent, ["tree_id", "parent_lo"]).select("tree_id", "lo", F.array_except("parent_set", "set").alias("siblings")).filter(F.size("siblings") > 0)


def prune(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Keeps the leaves named in ``kept(species)``, drops nodes left without any, and merges runs of single children.

    Nodes of one tree that hold the same leaves are one run: its top stays, with the lengths added.
    """
    return prune_to(nodes, leaves(nodes).join(kept.select("species").distinct(), "species", "left_semi"))


def prune_to(nodes: DataFrame, left: DataFrame) -> DataFrame:
    """`prune` to the leaf rows at hand (``tree_id, leaf``)."""
    left = left.select("tree_id", "leaf")
    inner = below(nodes, left).groupBy("tree_id", "lo").agg(F.min("leaf").alias("first"), F.max("leaf").alias("last"), F.count("*").alias("n"))
    own = left.select("tree_id", F.col("leaf").alias("lo"), F.col("leaf").alias("first"), F.col("leaf").alias("last"), F.lit(1).cast("long").alias("n"))
    held = inner.unionByName(own).join(nodes.select("tree_id", "lo", "label", "dist"), ["tree_id", "lo"])
    return held.groupBy("tree_id", "first", "last", "n").agg(F.min("lo").alias("lo"), F.max_by("label", "lo").alias("label"), F.sum("dist").alias("dist"))


def backbone(nodes: DataFrame) -> DataFrame:
    """The tree of the first copy of each species."""
    first = leaves(nodes).groupBy("tree_id", "species").agg(F.min("leaf").alias("leaf"))
    return prune_to(nodes, first)


def edge_table(nodes: DataFrame) -> DataFrame:
    """Edges in preorder: ``tree_id, edge_ix, lo, branch_length, clade_size`` (leaves below), ``depth``."""
    ix = F.row_number().over(W.partitionBy("tree_id").orderBy("lo")) - 1
    rows = walked(nodes).filter("parent_lo is not null")
    return rows.select("tree_id", ix.alias("edge_ix"), "lo", F.coalesce("dist", F.lit(0.0)).alias("branch_length"), (F.col("last") - F.col("first") + 1).alias("clade_size"), "depth")


def scale_lengths(nodes: DataFrame, factor: float) -> DataFrame:
    return nodes.withColumn("dist", F.col("dist") * factor)


def repeated_in_polytomies(nodes: DataFrame) -> DataFrame:
    """Inner nodes but the root whose children hold one species each, one of them twice or more: ``tree_id, lo, species, children, kept`` (the first child of the species).

    Nodes of one species are left to `single_species_clades`.
    """
    end, tree, parent = F.when(F.col("is_leaf"), F.col("lo")).otherwise(F.col("hi")), W.partitionBy("tree_id"), W.partitionBy("tree_id", "parent_lo")
    ordered = tree.orderBy("__end", "inner", F.desc("lo"))
    # in postorder: the last leaf so far, and the last that another species followed; behind a node's start there is none if it holds one species
    tip = F.when(F.col("is_leaf") & F.col("label").isNotNull(), F.struct("lo", "label"))
    rows = nodes.select("tree_id", "lo", "parent_lo", (~F.col("is_leaf")).alias("inner"), "label", end.alias("__end"), tip.alias("__tip"), F.collect_set(F.when(F.col("parent_lo").isNull(), F.col("lo"))).over(tree).alias("roots"))
    rows = rows.withColumns({"before": F.last("__tip", True).over(ordered.rowsBetween(W.unboundedPreceding, -1)), "now": F.last("__tip", True).over(ordered.rowsBetween(W.unboundedPreceding, 0))})
    changed = F.max(F.when(F.col("__tip.label") != F.col("before.label"), F.col("before.lo"))).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    inner = F.col("inner")
    rows = rows.withColumn("changed", changed).filter("parent_lo is not null and not array_contains(roots, parent_lo)")
    kinds = F.when(inner & (F.col("changed") >= F.col("lo")), 2).otherwise(1)
    species = F.when(~inner, F.col("label")).when(F.col("now.lo") >= F.col("lo"), F.col("now.label"))
    children = rows.select("tree_id", "parent_lo", "lo", kinds.alias("kinds"), species.alias("species")).groupBy("tree_id", "parent_lo", "species").agg(F.count("*").alias("children"), F.min("lo").alias("kept"), F.max("kinds").alias("kinds"))
    whole = children.withColumns({"widest": F.max("kinds").over(parent), "most": F.max("children").over(parent), "n": F.count("*").over(parent)}).filter("widest = 1 and most > 1 and n > 1")
    return whole.select("tree_id", F.col("parent_lo").alias("lo"), "species", "children", "kept")


def bipartitions(nodes: DataFrame) -> DataFrame:
    """Unrooted splits of trees with one leaf per species: ``tree_id, side`` (the smaller side, then the one that sorts first)."""
    single = leaves(nodes).groupBy("tree_id").agg(F.sort_array(F.collect_list("species")).alias("all"), F.count_distinct("species").alias("kinds")).filter(F.size("all") == F.col("kinds"))
    sets = species_sets(nodes).filter("parent_lo is not null").join(single, "tree_id")
    rest = F.array_except("all", "set")
    side = F.when(F.size("set") < F.size(rest), F.col("set")).when(F.size("set") > F.size(rest), rest).otherwise(F.least(F.col("set"), rest))
    return sets.filter((F.size("set") > 1) & (F.size(rest) > 1)).select("tree_id", F.array_join(side, ",").alias("side")).distinct()


def robinson_foulds(trees: DataFrame, reference: DataFrame) -> DataFrame:
    """Splits that only one of a tree and its reference has, and that number over all splits of both.

    Both are ``key, tree_id, side`` and ``key, side``: trees meet the reference of their key.
    """
    own = trees.groupBy("key", "tree_id").agg(F.count("*").alias("n"))
    other = reference.groupBy("key").agg(F.count("*").alias("m"))
    shared = trees.join(reference, ["key", "side"]).groupBy("tree_id").agg(F.count("*").alias("shared"))
    d = F.col("n") + F.col("m") - 2 * F.coalesce("shared", F.lit(0))
    return own.join(other, "key").join(shared, "tree_id", "left").select("tree_id", d.alias("rf"), (d / (F.col("n") + F.col("m"))).alias("normalised"))


def concordance(nodes: DataFrame, clades: DataFrame) -> DataFrame:
    """Share of informative trees in which a clade of a species tree is found as a clade or as the rest of one.

    ``clades`` is ``clade, species``. A tree is informative if two or more of the clade's species and
    one other are in it. Trees meet the clades of their species and are matched by hashed species sets.
    """
    species = leaves(nodes).select("tree_id", "species").distinct()
    own = species.groupBy("tree_id").agg(F.sort_array(F.collect_set("species")).alias("all"))
    met = species.join(clades.select("clade", "species").distinct(), "species").groupBy("tree_id", "clade").agg(F.sort_array(F.collect_set("species")).alias("inside")).filter(F.size("inside") > 1)
    asked = met.join(own, "tree_id").select("tree_id", "clade", "inside", F.array_except("all", "inside").alias("outside")).filter(F.size("outside") > 0)
    key = lambda c: F.xxhash64(F.array_join(c, ","))
    have = species_sets(nodes).select("tree_id", key("set").alias("key")).distinct()
    tries = asked.select("tree_id", "clade", F.explode(F.array(key("inside"), key("outside"))).alias("key"))
    met = tries.join(have, ["tree_id", "key"], "left_semi").select("tree_id", "clade").distinct().groupBy("clade").agg(F.count("*").alias("met"))
    return asked.groupBy("clade").agg(F.count("*").alias("informative")).join(met, "clade", "left").select("clade", "informative", (F.coalesce("met", F.lit(0)) / F.col("informative")).alias("concordance"))


def diverse_leaves(nodes: DataFrame, k: int = 1) -> DataFrame:
    """The k most diverse leaves of each species in a tree: ``tree_id, species, leaf``.

    One: that farthest from the root. More: the two most distant, then in turn that whose least
    distance to those taken is greatest; the first in order on ties. All, where there are no more than k.
    """
    if k == 1:
        return tip_distances(nodes).groupBy("tree_id", "species").agg(F.min_by("leaf", F.struct(-F.col("distance"), "leaf")).alias("leaf"))
    tips = leaves(nodes).select("tree_id", "species", "leaf").withColumn("n", F.count("*").over(W.partitionBy("tree_id", "species")))
    pairs = cut(copy_pairs(nodes), "copy_pairs")
    far = pairs.groupBy("tree_id", "species").agg(F.min_by(F.array("x", "y"), F.struct(-F.col("distance"), "x", "y")).alias("two"))
    taken = cut(far.select("tree_id", "species", F.explode("two").alias("leaf")), "taken")
    both = pairs.unionByName(pairs.select("tree_id", "species", F.col("y").alias("x"), F.col("x").alias("y"), "distance"))
    for _ in range(k - 2):
        rest = both.join(taken.withColumnRenamed("leaf", "x"), ["tree_id", "species", "x"], "left_anti").join(taken.withColumnRenamed("leaf", "y"), ["tree_id", "species", "y"], "left_semi")
        near = rest.groupBy("tree_id", "species", "x").agg(F.min("distance").alias("near"))
        more = near.groupBy("tree_id", "species").agg(F.min_by("x", F.struct(-F.col("near"), "x")).alias("leaf"))
        taken = cut(taken.unionByName(more), "taken")
    few = tips.filter(F.col("n") <= k).select("tree_id", "species", "leaf")
    many = tips.filter(F.col("n") > k).select("tree_id", "species").distinct()
    return few.unionByName(taken.join(many, ["tree_id", "species"], "left_semi"))
