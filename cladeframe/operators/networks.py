"""Folding multi-labelled trees into networks, and comparing networks by their copies and reticulations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folding
from .greedy import greedy
from .lineage import cut
from .trees import coded, leaves, levels


def live_nodes(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """The nodes that folding meets: ``tree_id, lo, hi, depth, parent_lo, is_leaf, label, code, tip, first, k, d``.

    From the root down the first copy of like subtrees stays and the others go with all below. The
    first of all nodes with a code is never below another copy, so a node is met just if no node
    above it is a later copy: intervals nest, so that is a running maximum over the tree. ``first``
    is the first copy of a node's kind, ``k`` how many of it are met, ``d`` under how many parents,
    ``tip`` the depth of the deepest leaf below. The result is a written table.
    """
    return cut(_live(nodes, max_height), "live")


def _live(nodes: DataFrame, max_height: int | None) -> DataFrame:
    """`live_nodes`, not written: all its steps keep trees where one shuffle has put them."""
    tree, kind = W.partitionBy("tree_id"), W.partitionBy("tree_id", "first")
    marked = coded(nodes, max_height).select("tree_id", "lo", "hi", "depth", "parent_lo", "is_leaf", "label", "code", "tip").withColumn("first", F.min("lo").over(W.partitionBy("tree_id", "code")))
    gone = F.max(F.when(F.col("lo") != F.col("first"), F.col("hi"))).over(tree.orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
    met = marked.withColumn("gone", gone).filter("gone is null or gone < lo").drop("gone")
    return met.withColumns({"k": F.count("*").over(kind), "d": F.size(F.collect_set("parent_lo").over(kind))})


def fold(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """Reticulations of each tree: groups of two or more like subtrees among `live_nodes`.

    Returns ``tree_id, ret_id`` (the first copy's number), ``last``, ``k`` copies, ``d`` distinct
    parents, ``height``, and the events: ``auto = k - d``, ``allo = d - 1``, and whether the group
    counts as one allopolyploid group.
    """
    return reticulations(nodes, _live(nodes, max_height))


def reticulations(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """`fold` from live nodes at hand, which hold all that it asks of ``nodes``."""
    rets = live.filter("k > 1 and lo = first").select("tree_id", F.col("lo").alias("ret_id"), F.col("hi").alias("last"), "k", F.col("d").cast("long").alias("d"), (F.col("tip") - F.col("depth")).cast("int").alias("height"))
    return rets.withColumns({"auto_events": F.col("k") - F.col("d"), "allo_events": F.col("d") - 1, "allo_group": (F.col("d") > 1).cast("int")})


def sister_sets(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """Species beside each reticulation, one row per distinct parent: ``tree_id, ret_id, side`` (the parent), ``sisters`` (sorted; empty where the parent has no other child)."""
    sides = live.filter("k > 1").select("tree_id", F.col("first").alias("ret_id"), F.col("parent_lo").alias("side")).distinct()
    beside = live.select("tree_id", F.col("parent_lo").alias("side"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("first").alias("kind"))
    own = sides.join(beside, ["tree_id", "side"]).filter("kind <> ret_id")
    met = own.join(leaves(nodes).select("tree_id", "leaf", "species"), "tree_id").filter("leaf between from and to")
    found = met.groupBy("tree_id", "ret_id", "side").agg(F.sort_array(F.collect_set("species")).alias("sisters"))
    return sides.join(found, ["tree_id", "ret_id", "side"], "left").withColumn("sisters", F.coalesce("sisters", F.array().cast("array<string>")))


def network_stats(nodes: DataFrame, reticulations: DataFrame) -> DataFrame:
    """Per tree: species, polyploids, most copies, and the totals of its reticulations."""
    copies = leaf_counts(nodes).groupBy("tree_id").agg(F.count("*").alias("num_species"), F.count(F.when(F.col("n") > 1, 1)).alias("num_polyploids"), F.max("n").alias("max_copies"))
    events = reticulations.groupBy("tree_id").agg(F.count("*").alias("reticulations"), *(F.sum(c).alias(c) for c in ("auto_events", "allo_events", "allo_group")))
    return copies.join(events, "tree_id", "left").na.fill(0).withColumn("total_events", F.col("auto_events") + F.col("allo_events"))


def leaf_counts(nodes: DataFrame) -> DataFrame:
    return leaves(nodes).groupBy("tree_id", "species").agg(F.count("*").alias("n"))


def reticulation_leaves(nodes: DataFrame, reticulations: DataFrame) -> DataFrame:
    """Species below each reticulation: ``tree_id, ret_id, species``."""
    return reticulations.select("tree_id", "ret_id", "last").join(leaves(nodes), "tree_id").filter("leaf between ret_id and last").select("tree_id", "ret_id", "species").distinct()


def duplicated_siblings(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """Per tree: groups of like sibling clades that lie in no other such group, and the copies beyond the first."""
    codes = coded(nodes, max_height).filter("parent_lo is not null")
    groups = cut(codes.groupBy("tree_id", "parent_lo", "code").agg(F.count("*").alias("k"), F.collect_list(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("members")).filter("k > 1"), "groups")
    members = groups.select(F.col("tree_id").alias("t"), F.explode("members").alias("m")).select("t", "m.a", "m.b")
    top = groups.join(members, (F.col("tree_id") == F.col("t")) & F.col("parent_lo").between(F.col("a"), F.col("b")), "left_anti")
    return top.groupBy("tree_id").agg(F.count("*").alias("groups"), F.sum(F.col("k") - 1).alias("events"))


def _both(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(c, F.lit(0))
    t, i = truth.select("tree_id", "species", F.col("n").alias("t")), inferred.select("tree_id", "species", F.col("n").alias("i"))
    return t.join(i, ["tree_id", "species"], "full").select("tree_id", "species", n(F.col("t")).alias("t"), n(F.col("i")).alias("i"))


def count_difference(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """Signed (inferred - truth) and absolute difference of reticulation counts, ``tree_id, n``."""
    return count_differences(truth.select("tree_id", F.col("n").alias("t")).join(inferred.select("tree_id", F.col("n").alias("i")), "tree_id", "full"))


def count_differences(both: DataFrame) -> DataFrame:
    """`count_difference` from the true and the inferred count side by side, ``tree_id, t, i``."""
    d = F.coalesce("i", F.lit(0)) - F.coalesce("t", F.lit(0))
    return both.select("tree_id", d.alias("signed"), F.abs(d).alias("abs"))


def ploidy_difference(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """Distance over copies beyond the first, with true and false positives and false negatives; an absent species has -1."""
    c1, c2 = F.col("t") - 1, F.col("i") - 1
    rows = _both(truth, inferred).filter((c1 != 0) | (c2 != 0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per = rows.groupBy("tree_id").agg(total(F.least(c1, c2)).alias("tp"), total(F.greatest(c2 - c1, F.lit(0))).alias("fp"), total(F.greatest(c1 - c2, F.lit(0))).alias("fn"), total(F.greatest(c1, c2)).alias("union"))
    every = truth.select("tree_id").union(inferred.select("tree_id")).distinct()
    return every.join(per, "tree_id", "left").na.fill(0).select("tree_id", F.when(F.col("union") == 0, 0.0).otherwise(1 - F.col("tp") / F.col("union")).alias("dist"), "tp", "fp", "fn")


def polyploid_jaccard(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """Jaccard distance of the sets of species with more than one copy; 0 where both are empty."""
    a, b = F.col("t") > 1, F.col("i") > 1
    per = _both(truth, inferred).groupBy("tree_id").agg(F.count(F.when(a & b, 1)).alias("both"), F.count(F.when(a | b, 1)).alias("any"))
    return per.select("tree_id", F.when(F.col("any") == 0, 0.0).otherwise(1 - F.col("both") / F.col("any")).alias("dist"))


def copy_difference(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """Size of the multiset difference of leaves, whether it is 0, and the least share of an edit distance it forces (two edits a leaf, normalised by twice the larger leaf count)."""
    per = _both(truth, inferred).groupBy("tree_id").agg(F.sum(F.abs(F.col("t") - F.col("i"))).alias("copy_diff"), F.sum("t").alias("n_truth"), F.sum("i").alias("n_inferred"))
    return per.select("tree_id", "n_truth", "n_inferred", "copy_diff", (F.col("copy_diff") == 0).alias("copies_match"), (F.col("copy_diff") / F.greatest("n_truth", "n_inferred")).alias("floor"))


def polyploid_detection(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the polyploid species of each tree (0 where undefined), ploidy accuracy and count error."""
    a, b = F.greatest("t", F.lit(1)) > 1, F.greatest("i", F.lit(1)) > 1
    n = lambda c: F.count(F.when(c, 1))
    per = _both(truth, inferred).groupBy("tree_id").agg(n(a & b).alias("tp"), n(b & ~a).alias("fp"), n(a & ~b).alias("fn"), F.avg((F.greatest("t", F.lit(1)) == F.greatest("i", F.lit(1))).cast("double")).alias("accuracy"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.select("tree_id", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "accuracy", F.abs(fp - fn).alias("count_error"))


def identical(distances: DataFrame, columns: list[str]) -> DataFrame:
    """Whether all distances of a pair are 0."""
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) == 0)
    return distances.select("tree_id", same.alias("identical"))


TREE = ("tree_id",)


def match_reticulations(left: DataFrame, right: DataFrame, keys: Sequence[str] = TREE) -> DataFrame:
    """One-to-one pairs of reticulations of the same tree by the Jaccard similarity of their leaf sets.

    ``left`` and ``right`` are ``tree_id`` (or other ``keys``), ``ret_id, species``. Pairs that share a
    species are scored from counts and taken from the best on (ties by ids), each end once: in a round
    of `greedy` those that are each other's best. Returns the keys, ``a, b, shared, n_a, n_b``.
    """
    keys = list(keys)
    size = lambda d, name: d.groupBy(*keys, "ret_id").agg(F.count("*").alias(f"n_{name}")).withColumnRenamed("ret_id", name)
    shared = left.withColumnRenamed("ret_id", "a").join(right.withColumnRenamed("ret_id", "b"), [*keys, "species"]).groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))
    pairs = shared.join(size(left, "a"), [*keys, "a"]).join(size(right, "b"), [*keys, "b"])
    pairs = pairs.withColumn("score", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
    ends = F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("of")), F.struct(F.lit("b").alias("end"), F.col("b").alias("of")))
    rows = pairs.select("*", F.explode(ends).alias("p")).select(*pairs.columns, "p.end", "p.of")
    met = greedy(rows, [*keys, "a", "b"], [*keys, "end", "of"], [F.desc("score"), F.col("a"), F.col("b")], F.lit(1), keys)
    return met.filter("end = 'a'").select(*keys, "a", "b", "shared", "n_a", "n_b")


def all_matched(matches: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str] = TREE) -> DataFrame:
    """Adds to the matches pairs of what is left on both sides, in order of ids: they share nothing.

    ``left`` and ``right`` are the keys, ``ret_id`` and its size ``n``.
    """
    keys = list(keys)

    def rest(side: DataFrame, name: str) -> DataFrame:
        free = side.withColumnRenamed("ret_id", name).join(matches.select(*keys, name), [*keys, name], "left_anti")
        return free.select(*keys, name, F.col("n").alias(f"n_{name}"), F.row_number().over(W.partitionBy(*keys).orderBy(name)).alias("rank"))

    more = rest(left, "a").join(rest(right, "b"), [*keys, "rank"]).withColumn("shared", F.lit(0).cast("long"))
    return matches.unionByName(more.select(matches.columns))


def _normalised(per: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over matched pairs (``dist, fp, fn``) to the penalised and the matched form.

    Penalised: what has no partner counts 1, over the larger count; a side without any has distance
    1, false positives or negatives alone. Matched (``*_matched``): over the pairs alone.
    """
    count = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), list(keys), "full").join(per, list(keys), "left").na.fill(0)
    l, r = F.col("l"), F.col("r")  # noqa: E741
    most, least = F.greatest(l, r), F.least(l, r)
    none = lambda ends, x: F.when(l == 0, ends[0]).when(r == 0, ends[1]).otherwise(x)
    full = {"dist": none((1.0, 1.0), (F.col("dist") + most - least) / most), "fp": none((1.0, 0.0), (F.col("fp") + most - l) / most), "fn": none((0.0, 1.0), (F.col("fn") + most - r) / most)}
    found = {f"{c}_matched": none(ends, F.col(c) / least) for c, ends in (("dist", (1.0, 1.0)), ("fp", (1.0, 0.0)), ("fn", (0.0, 1.0)))}
    every = {**full, "tp": none((0.0, 0.0), 1 - full["dist"]), **found, "tp_matched": none((0.0, 0.0), 1 - found["dist_matched"])}
    return both.select(*keys, *(x.alias(c) for c, x in every.items()))


def _pair_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    s, a, b = F.col("shared"), F.col("n_a"), F.col("n_b")
    ratio = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return pairs.groupBy(*keys).agg(F.sum(ratio(a + b - 2 * s, a + b - s)).alias("dist"), F.sum(ratio(b - s, b)).alias("fp"), F.sum(ratio(a - s, a)).alias("fn"))


def leaf_set_distance(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Distance, false and true positives and false negatives of reticulations by their leaf sets, in the penalised and the matched form (``*_matched``).

    Of the trees with a reticulation on either side; see `_normalised` for those without on one.
    """
    size = lambda d: d.groupBy("tree_id", "ret_id").agg(F.count("*").alias("n"))
    l, r = size(left), size(right)  # noqa: E741
    return _normalised(_pair_sums(all_matched(matches, l, r), TREE), l, r, TREE)


def sister_set_distance(matches: DataFrame, left: DataFrame, right: DataFrame, left_sisters: DataFrame, right_sisters: DataFrame) -> DataFrame:
    """As `leaf_set_distance`, with the distance of a pair of reticulations that of their sister sets (`sister_sets`), matched in turn.

    Two parents without another child are alike.
    """
    size = lambda d: d.groupBy("tree_id", "ret_id").agg(F.count("*").alias("n"))
    l, r = size(left), size(right)  # noqa: E741
    pairs = cut(all_matched(matches, l, r).select("tree_id", F.col("a").alias("ret_a"), F.col("b").alias("ret_b")), "ret_pairs")
    keys = ["tree_id", "ret_a", "ret_b"]

    def sides(sets: DataFrame, name: str) -> DataFrame:
        return pairs.join(sets.withColumnRenamed("ret_id", name), ["tree_id", name]).select(*keys, F.col("side").alias("ret_id"), "sisters")

    def members(d: DataFrame) -> DataFrame:
        return d.select(*keys, "ret_id", F.explode(F.when(F.size("sisters") > 0, F.col("sisters")).otherwise(F.array(F.lit("")))).alias("species"))

    x, y = cut(sides(left_sisters, "ret_a"), "sides"), cut(sides(right_sisters, "ret_b"), "sides")
    counted = lambda d: d.select(*keys, "ret_id", F.size("sisters").cast("long").alias("n"))
    inner = _normalised(_pair_sums(all_matched(match_reticulations(members(x), members(y), keys), counted(x), counted(y), keys), keys), counted(x), counted(y), keys)
    return _normalised(inner.groupBy("tree_id").agg(*(F.sum(c).alias(c) for c in ("dist", "fp", "fn"))), l, r, TREE)


def network_edges(live: DataFrame) -> DataFrame:
    """Distinct edges of the folded networks, ``tree_id, parent, child``.

    A node is named by its number; the reticulation above the copies of node n is -n - 1.
    """
    ret = -F.col("first") - 1
    down = live.filter("parent_lo is not null").select("tree_id", F.col("parent_lo").alias("parent"), F.when(F.col("k") > 1, ret).otherwise(F.col("lo")).alias("child"))
    return down.unionByName(live.filter("k > 1").select("tree_id", ret.alias("parent"), F.col("first").alias("child"))).distinct()


def _idle(edges: DataFrame) -> DataFrame:
    """Nodes with one way in and one way out, as links to what follows: ``tree_id, node, to``."""
    down = edges.select("tree_id", F.col("parent").alias("node"), F.col("child").alias("to"), F.lit(0).alias("ins"))
    up = edges.select("tree_id", F.col("child").alias("node"), F.lit(None).alias("to"), F.lit(1).alias("ins"))
    per = down.unionByName(up).groupBy("tree_id", "node").agg(F.sum("ins").alias("ins"), F.count("to").alias("outs"), F.max("to").alias("to"))
    return per.filter("ins = 1 and outs = 1").select("tree_id", "node", "to")


def _ends(links: DataFrame) -> DataFrame:
    """Where chains of idle nodes end, by doubling, three times a write: ``tree_id, node, to, open``."""
    links = links.withColumn("open", F.lit(True))
    while True:
        for _ in range(3):
            on = links.select("tree_id", F.col("node").alias("to"), F.col("to").alias("then"), F.col("open").alias("then_open"))
            links = links.join(on, ["tree_id", "to"], "left").select("tree_id", "node", F.coalesce("then", "to").alias("to"), F.coalesce("then_open", F.lit(False)).alias("open"))
        links = cut(links, "links")
        if links.filter("open").isEmpty():
            return links


def suppressed(edges: DataFrame) -> DataFrame:
    """Edges after nodes with one way in and one way out have been passed over, until there is none; parallel edges become one.

    All chains are passed over at once, each in as many rounds as its length has binary digits over
    three; what edges become one may leave new idle nodes, so this is repeated until there is none.
    """
    edges, done = cut(edges, "edges"), []
    while True:
        ends = _ends(_idle(edges))
        if ends.isEmpty():
            break
        # only trees that had an idle node can have one in the next round
        trees = ends.select("tree_id").distinct()
        done.append(edges.join(trees, "tree_id", "left_anti"))
        left = edges.join(trees, "tree_id", "left_semi").join(ends.select("tree_id", F.col("node").alias("parent")), ["tree_id", "parent"], "left_anti")
        met = left.join(ends.select("tree_id", F.col("node").alias("child"), "to"), ["tree_id", "child"], "left")
        edges = cut(met.select("tree_id", "parent", F.coalesce("to", "child").alias("child")).distinct(), "edges")
    return cut(reduce(DataFrame.unionByName, done, edges), "edges") if done else edges


def network_class(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether path-count vectors tell networks apart: ``tree_id, stacked, offending, taxa, in_class``.

    ``stacked``: reticulations right below one; ``offending``: nodes whose degrees are not those of a
    leaf (one way in), a reticulation (one out) or a tree node (two out). ``edges`` are suppressed.
    """
    ins = edges.groupBy("tree_id", F.col("child").alias("node")).agg(F.count("*").alias("ins"))
    outs = edges.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count("*").alias("outs"))
    degrees = ins.join(outs, ["tree_id", "node"], "full").na.fill(0)
    odd = F.when(F.col("outs") == 0, F.col("ins") != 1).when(F.col("ins") > 1, F.col("outs") != 1).otherwise(F.col("outs") != 2)
    bad = degrees.groupBy("tree_id").agg(F.count(F.when(odd, 1)).alias("offending"))
    many = ins.filter("ins > 1").select("tree_id", "node")
    stacked = edges.join(many.withColumnRenamed("node", "parent"), ["tree_id", "parent"], "left_semi").join(many.withColumnRenamed("node", "child"), ["tree_id", "child"], "left_semi").groupBy("tree_id").agg(F.count("*").alias("stacked"))
    taxa = leaves(nodes).groupBy("tree_id").agg(F.sort_array(F.collect_set("species")).alias("taxa"))
    every = taxa.join(bad, "tree_id", "left").join(stacked, "tree_id", "left").withColumns({"offending": F.coalesce("offending", F.lit(1)), "stacked": F.coalesce("stacked", F.lit(0))})
    return every.select("tree_id", "stacked", "offending", "taxa", ((F.col("stacked") == 0) & (F.col("offending") == 0)).alias("in_class"))


def mu_vectors(nodes: DataFrame, max_height: int | None = None) -> DataFrame:
    """Path-count vector of every network node: ``tree_id, node, in_degree, vector`` (sorted ``species:paths``), reticulations included."""
    if max_height is not None:
        levels(nodes, max_height)
    return folding.vectors(folding.packed(nodes))


def path_vectors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`mu_vectors` over suppressed edges at hand, for all trees at once.

    Walks of length 2^i are joined with themselves, and those to leaves of less than 2^i steps with
    them, so a network of depth n takes log2(n) rounds, of one written table each.
    """
    lone = leaves(nodes).select("tree_id", F.col("leaf").alias("node"), "species")
    in_network = edges.select("tree_id", F.explode(F.array("parent", "child")).alias("node")).distinct()
    alone = lone.join(edges.select("tree_id").distinct(), "tree_id", "left_anti")
    done = lone.join(in_network, ["tree_id", "node"], "left_semi").unionByName(alone).withColumn("paths", F.lit(1).cast("long"))
    step = edges.select("tree_id", F.col("parent").alias("x"), F.col("child").alias("y"), F.lit(1).cast("long").alias("w"))
    while True:
        # walks (y is set) and paths (species is set) in one table
        walks = step.select("tree_id", "x", "y", F.lit(None).cast("string").alias("species"), F.col("w").alias("n"))
        state = cut(walks.unionByName(done.select("tree_id", F.col("node").alias("x"), F.lit(None).cast("long").alias("y"), "species", F.col("paths").alias("n"))), "walks")
        step = state.filter("y is not null").select("tree_id", "x", "y", F.col("n").alias("w"))
        done = state.filter("y is null").select("tree_id", F.col("x").alias("node"), "species", F.col("n").alias("paths"))
        if step.isEmpty():
            break
        on = step.join(done.withColumnRenamed("node", "y"), ["tree_id", "y"]).select("tree_id", F.col("x").alias("node"), "species", (F.col("w") * F.col("paths")).alias("paths"))
        twice = step.join(step.select("tree_id", F.col("x").alias("y"), F.col("y").alias("z"), F.col("w").alias("v")), ["tree_id", "y"])
        done = done.unionByName(on).groupBy("tree_id", "node", "species").agg(F.sum("paths").alias("paths"))
        step = twice.groupBy("tree_id", "x", F.col("z").alias("y")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))
    ins = edges.groupBy("tree_id", F.col("child").alias("node")).agg(F.count("*").alias("in_degree"))
    vectors = done.groupBy("tree_id", "node").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "species", F.col("paths").cast("string")))), ",").alias("vector"))
    return cut(vectors.join(ins, ["tree_id", "node"], "left").select("tree_id", "node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "vector"), "vectors")


def mu_distance(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """Share of vectors (with in-degree) of either network of a pair whose value the other lacks: ``tree_id, distance``."""
    key = ["tree_id", "in_degree", "vector"]
    alone = lambda a, b: a.join(b.select(key).distinct(), key, "left_anti").groupBy("tree_id").agg(F.count("*").alias("alone"))
    both = truth.select(key).unionByName(inferred.select(key)).groupBy("tree_id").agg(F.count("*").alias("total"))
    off = alone(truth, inferred).unionByName(alone(inferred, truth)).groupBy("tree_id").agg(F.sum("alone").alias("alone"))
    return both.join(off, "tree_id", "left").select("tree_id", (F.coalesce("alone", F.lit(0)) / F.col("total")).alias("distance"))


def scored_mu_distance(distance: DataFrame, truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """`mu_distance` where it is defined: ``tree_id, mu_distance, mu_scored``; null and 0 where a network is out of its class or the taxa differ.

    ``truth`` and ``inferred`` are `network_class` of either side.
    """
    a, b = (d.select("tree_id", F.col("in_class").alias(f"ok_{x}"), F.col("taxa").alias(f"taxa_{x}")) for d, x in ((truth, "a"), (inferred, "b")))
    ok = F.col("ok_a") & F.col("ok_b") & (F.col("taxa_a") == F.col("taxa_b"))
    return a.join(b, "tree_id").join(distance, "tree_id", "left").select("tree_id", F.when(ok, F.col("distance")).alias("mu_distance"), ok.cast("double").alias("mu_scored"))


def _texts(nodes: DataFrame, tree: str, name: str) -> DataFrame:
    return folding.packed(nodes).select(F.col("tree_id").alias(tree), F.col("text").alias(name))


def mu_distances(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """`scored_mu_distance` of trees with equal ids, from nodes: ``tree_id, mu_distance, mu_scored``."""
    pairs = _texts(truth, "tree_id", "a").join(_texts(inferred, "tree_id", "b"), "tree_id")
    return folding.measured(pairs, folding.mu_forms).select("tree_id", F.get("values", F.lit(0)).alias("mu_distance"), F.get("values", F.lit(1)).alias("mu_scored"))


def sister_set_distances(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """`sister_set_distance` of trees with equal ids, from nodes; a tree on one side only is held against none."""
    pairs = _texts(truth, "tree_id", "a").join(_texts(inferred, "tree_id", "b"), "tree_id", "full")
    rows = folding.measured(pairs, folding.sister_forms).filter("values is not null")
    return rows.select("tree_id", *(F.get("values", F.lit(i)).alias(c) for i, c in enumerate(FORMS)))


#: Methods that infer one reticulation by design: what they did not look for is no error of theirs.
SINGLE_RETICULATION = ("grampa",)
PAIR = ("network", "config", "method", "replicate")
#: What `folding` has for distances of sets, penalised and matched, and how measures name a form's four.
FORMS = ("dist", "fp", "fn", "tp", "dist_matched", "fp_matched", "fn_matched", "tp_matched")
KINDS = ("dist", "FP", "FN", "TP")


def compare_networks(truth: DataFrame, inferred: DataFrame, pairs: DataFrame) -> DataFrame:
    """All measures of each pair of networks, one row a measure: ``network, config, method, replicate, metric, value, jaccard_mode, status``.

    ``truth`` and ``inferred`` are node tables of multi-labelled trees. ``pairs`` names the trees of a
    run: the four keys, ``truth_id`` and ``inferred_id``. A pair meets its trees as texts, and its
    measures are made in one row. A pair without nodes on a side is one row FAILED with a null value.
    Methods in `SINGLE_RETICULATION` have their set distances over matched pairs alone (``partial``).
    """
    met = pairs.select(*PAIR, "truth_id", "inferred_id").join(_texts(truth, "truth_id", "a"), "truth_id", "left").join(_texts(inferred, "inferred_id", "b"), "inferred_id", "left")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    text = lambda c: F.when(ok, F.col(c)).alias(c)
    rows = folding.measured(met.select(*PAIR, text("a"), text("b")), folding.all_forms)
    partial_, good = F.col("method").isin(*SINGLE_RETICULATION), F.col("values").isNotNull()
    v = lambda i: F.get("values", F.lit(i))
    # places as in `folding.all_forms`
    values = {"num_rets_diff": F.abs(v(1) - v(0)), "num_rets_bias": v(1) - v(0), **{f"ploidy_diff.{k}": v(2 + i) for i, k in enumerate(KINDS)}, "polyploid_species_jaccard": v(6)}
    for name, at in (("ret_leaf_jaccard", 7), ("ret_sisters_jaccard", 15)):
        values |= {f"{name}.{k}": F.when(partial_, v(at + 4 + i)).otherwise(v(at + i)) for i, k in enumerate(KINDS)}
        values |= {f"{name}_matched.{k}": v(at + 4 + i) for i, k in enumerate(KINDS)}
    values |= {"mu_distance": v(23), "mu_scored": v(24)}
    row = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.alias("value"))
    measures = F.when(good, F.array(*(row(k, x) for k, x in values.items()))).otherwise(F.array(row("FAILED", F.lit(None).cast("double"))))
    mode = F.when(good, F.when(partial_, "partial").otherwise("standard")).alias("jaccard_mode")
    status = F.when(good, "SUCCESS").otherwise("FAILED").alias("status")
    return rows.select(*PAIR, F.explode(measures).alias("m"), mode, status).select(*PAIR, "m.metric", "m.value", "jaccard_mode", "status")
