"""Copy numbers, sister profiles and cluster support over a corpus of trees.

``leaves`` has one row per leaf: ``sample_id, tree_id, species`` and its ``parent_lo``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def copies_per_tree(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("sample_id", "tree_id", "species").agg(F.count("*").alias("n"))


def copy_distribution(copies: DataFrame) -> DataFrame:
    """In how many trees of the sample a species has n copies."""
    return copies.groupBy("sample_id", "species", "n").agg(F.count("*").alias("freq"))


def with_absences(distribution: DataFrame, copies: DataFrame) -> DataFrame:
    """Adds n = 0 for the trees of the sample that lack the species."""
    trees = copies.groupBy("sample_id").agg(F.count_distinct("tree_id").alias("trees"))
    some = distribution.groupBy("sample_id", "species").agg(F.sum("freq").alias("some"))
    none = some.join(trees, "sample_id").select("sample_id", "species", F.lit(0).cast("long").alias("n"), (F.col("trees") - F.col("some")).alias("freq")).filter("freq > 0")
    return distribution.unionByName(none)


def representative_copies(distribution: DataFrame, width: int = 2) -> DataFrame:
    """The copy number that stands for a species in a sample.

    One number met: that one; two: the more frequent (the smaller on a tie); more: the peak of the
    frequencies smoothed by the triangular kernel ``1 - d / (width + 1)`` (the smaller on a tie).
    """
    kinds = distribution.withColumn("kinds", F.count("*").over(W.partitionBy("sample_id", "species")))
    other = distribution.select("sample_id", "species", F.col("n").alias("m"), F.col("freq").alias("f"))
    d = F.abs(F.col("n") - F.col("m"))
    smooth = kinds.join(other, ["sample_id", "species"]).filter(d <= width).groupBy("sample_id", "species", "kinds", "n", "freq").agg(F.sum(F.col("f") * (1 - d / (width + 1))).alias("peak"))
    weight = F.round(F.when(F.col("kinds") > 2, F.col("peak")).otherwise(F.col("freq")), 9)
    return smooth.groupBy("sample_id", "species").agg(F.min_by("n", F.struct(-weight, "n")).alias("copies"))


def representative_copies_with_absences(copies: DataFrame, width: int = 2) -> DataFrame:
    """`representative_copies` with the trees that lack a species counted as 0 copies; 1 at least."""
    found = representative_copies(with_absences(copy_distribution(copies), copies), width)
    return found.withColumn("copies", F.greatest("copies", F.lit(1)))


def consensus_bound(copies: DataFrame, floor: int = 1) -> DataFrame:
    """The largest k such that at least half of the sample's trees hold k copies or more, ``floor`` at least."""
    trees = copies.groupBy("sample_id").agg(F.count_distinct("tree_id").alias("trees"))
    reach = F.sum("freq").over(W.partitionBy("sample_id", "species").orderBy(F.desc("n")))
    held = copy_distribution(copies).withColumn("reach", reach).join(trees, "sample_id")
    return held.groupBy("sample_id", "species").agg(F.greatest(F.coalesce(F.max(F.when(2 * F.col("reach") >= F.col("trees"), F.col("n"))), F.lit(0)), F.lit(floor)).alias("bound"))


def copy_features(copies: DataFrame) -> DataFrame:
    """Mean, population variance, mode (the smaller on a tie), shares of 0, 1, 2 and more copies, and the most, absences counted."""
    full = with_absences(copy_distribution(copies), copies)
    f, n = F.col("freq"), F.col("n")
    total = F.sum(f)
    share = lambda c: F.sum(F.when(c, f).otherwise(0)) / total
    mean = F.sum(n * f) / total
    return full.groupBy("sample_id", "species").agg(mean.alias("mean"), (F.sum(n * n * f) / total - mean * mean).alias("variance"), F.min_by(n, F.struct(-f, n)).alias("mode"), share(n == 0).alias("p0"), share(n == 1).alias("p1"), share(n == 2).alias("p2"), share(n >= 3).alias("p3"), F.max(n).alias("most"))


def sister_pairs(leaves: DataFrame) -> DataFrame:
    """Ordered pairs of different species under one parent, once per tree."""
    own = leaves.select("sample_id", "tree_id", "parent_lo", "species").distinct()
    return own.join(own.withColumnRenamed("species", "partner"), ["sample_id", "tree_id", "parent_lo"]).filter("species <> partner").select("sample_id", "tree_id", "species", "partner").distinct()


def coclustering(leaves: DataFrame, conditional: bool = False) -> DataFrame:
    """Share of trees in which two species are direct sisters: of all trees of the sample, or of those where the first is duplicated."""
    return sister_counts(leaves, conditional).select("sample_id", "species", "partner", (F.col("k") / F.col("total")).alias("share"))


def sister_counts(leaves: DataFrame, conditional: bool = False) -> DataFrame:
    """The counts behind `coclustering`: ``sample_id, species, partner, k, total``."""
    pairs = sister_pairs(leaves)
    if conditional:
        doubled = copies_per_tree(leaves).filter("n >= 2").select("sample_id", "tree_id", "species")
        total = doubled.groupBy("sample_id", "species").agg(F.count("*").alias("total"))
        return pairs.join(doubled, ["sample_id", "tree_id", "species"], "left_semi").groupBy("sample_id", "species", "partner").agg(F.count("*").alias("k")).join(total, ["sample_id", "species"]).select("sample_id", "species", "partner", "k", "total")
    trees = leaves.groupBy("sample_id").agg(F.count_distinct("tree_id").alias("total"))
    return pairs.groupBy("sample_id", "species", "partner").agg(F.count("*").alias("k")).join(trees, "sample_id").select("sample_id", "species", "partner", "k", "total")


def profile_summary(counts: DataFrame, species: DataFrame, whole: bool = True) -> DataFrame:
    """Mean, population std, max, min and median of a species' shares over all other species of the sample, absent pairs as 0.

    ``counts`` is `sister_counts` of all trees. A sample's shares have one total, so mean and std come
    from whole numbers and are divided once: the order of addition changes nothing. Without ``whole``
    the mean is the average of the shares as doubles, as SQL's avg has it, which may lie a last digit beside.
    """
    grid = species.join(species.withColumnRenamed("species", "partner"), "sample_id").filter("species <> partner")
    k, n = F.coalesce("k", F.lit(0)), F.count("*")
    total = F.coalesce(F.max("total"), F.lit(1))
    per = grid.join(counts, ["sample_id", "species", "partner"], "left").groupBy("sample_id", "species").agg(n.alias("n"), total.alias("total"), F.sum(k).alias("s"), F.sum(k * k).alias("q"), F.max(k).alias("most"), F.min(k).alias("least"), F.percentile(k, 0.5).alias("middle"), F.avg(F.coalesce(F.col("k") / F.col("total"), F.lit(0.0))).alias("average"))
    c = F.col
    return per.select("sample_id", "species", (c("s") / (c("n") * c("total")) if whole else c("average")).alias("mean"), (F.sqrt((c("n") * c("q") - c("s") * c("s")).cast("double")) / (c("n") * c("total"))).alias("std"), (c("most") / c("total")).alias("max"), (c("least") / c("total")).alias("min"), (c("middle") / c("total")).alias("median"))


def effective_partners(matrix: DataFrame) -> DataFrame:
    """``(sum c)^2 / sum c^2`` of each species' shares."""
    c = F.col("share")
    return matrix.groupBy("sample_id", "species").agg((F.sum(c) * F.sum(c) / F.sum(c * c)).alias("n_eff"))


def clade_coclustering(matrix: DataFrame, clades: DataFrame) -> DataFrame:
    """Mean and greatest share between the species of two clades (``clades``: clade, species)."""
    size = clades.groupBy("clade").agg(F.count("*").alias("size"))
    rows = matrix.join(clades, "species").join(clades.select(F.col("species").alias("partner"), F.col("clade").alias("other")), "partner")
    found = rows.groupBy("sample_id", "clade", "other").agg(F.sum("share").alias("total"), F.max("share").alias("max"))
    other = size.select(F.col("clade").alias("other"), F.col("size").alias("other_size"))
    return found.join(size, "clade").join(other, "other").select("sample_id", "clade", "other", (F.col("total") / (F.col("size") * F.col("other_size"))).alias("mean"), "max")


def clade_summaries(leaves: DataFrame, clades: DataFrame) -> DataFrame:
    """Per sample and clade over the trees that hold it: duplication frequency, mean extra copies, copies a species, coherence, copies in to out, and variation.

    A tree's clade is duplicated if a species of it has two copies or more; coherence is the share
    of the clade's present species that do. ``variation`` is the sample std of the copies of all its
    species, absent ones as 0, over their mean; null for clades of one species.
    """
    sized = clades.withColumn("size", F.count("*").over(W.partitionBy("clade")))
    copies = copies_per_tree(leaves).join(sized, "species")
    per = copies.groupBy("sample_id", "tree_id", "clade").agg(F.first("size").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("kinds"), F.sum("n").alias("inside"), F.sum((F.col("n") >= 2).cast("long")).alias("doubled"))
    tree = W.partitionBy("sample_id", "tree_id")
    out = (F.sum("inside").over(tree) - F.col("inside")) / F.nullif(F.sum("kinds").over(tree) - F.col("kinds"), F.lit(0))
    c = F.col
    spread = F.when(c("size") > 1, F.sqrt((c("size") * c("squares") - c("inside") * c("inside")) / (c("size") * (c("size") - 1))) * c("size") / c("inside"))
    per = per.withColumns({"out": out, "in": F.col("inside") / F.col("kinds")}).withColumn("variation", spread)
    return per.groupBy("sample_id", "clade").agg(F.avg((F.col("doubled") > 0).cast("double")).alias("duplication"), F.avg(F.col("inside") - F.col("kinds")).alias("extra"), F.avg(F.col("in")).alias("per_species"), F.avg(F.col("doubled") / F.col("kinds")).alias("coherence"), F.avg(F.col("in") / F.col("out")).alias("in_out"), F.avg("variation").alias("variation"))


def duplication_synchrony(copies: DataFrame) -> DataFrame:
    """Pearson correlation over a sample's trees of whether two species are duplicated, from counts alone."""
    flags = copies.withColumn("d", (F.col("n") >= 2).cast("double"))
    trees = copies.groupBy("sample_id").agg(F.count_distinct("tree_id").alias("t"))
    ones = flags.groupBy("sample_id", "species").agg(F.sum("d").alias("s"))
    doubled = flags.filter("d = 1").select("sample_id", "tree_id", "species")
    both = doubled.join(doubled.withColumnRenamed("species", "partner"), ["sample_id", "tree_id"]).filter("species < partner").groupBy("sample_id", "species", "partner").agg(F.count("*").alias("both"))
    pairs = ones.join(ones.select("sample_id", F.col("species").alias("partner"), F.col("s").alias("s2")), "sample_id").filter("species < partner").join(both, ["sample_id", "species", "partner"], "left").join(trees, "sample_id")
    t, s, s2 = F.col("t"), F.col("s"), F.col("s2")
    spread = F.sqrt((t * s - s * s) * (t * s2 - s2 * s2))
    return pairs.select("sample_id", "species", "partner", F.when(spread > 0, (t * F.coalesce("both", F.lit(0)) - s * s2) / spread).alias("r"))


def flag_correlation(t: Column, s1: Column, s2: Column, both: Column) -> Column:
    """Pearson correlation of two flags over ``t`` trees that ``s1``, ``s2`` and ``both`` of them have; neither may be all or none.

    The product of the spreads grows with the fourth power of ``t`` and passes a long from about 100,000 trees on.
    """
    return (t * both - s1 * s2) / F.sqrt((t * s1 - s1 * s1).cast("double") * (t * s2 - s2 * s2))


def detection_features(nodes: DataFrame, clades: DataFrame) -> DataFrame:
    """What tells a whole clade's duplication from that of single genes, per sample and clade.

    ``sample_id, clade, synchrony, mirrored, divergence, divergence_cv, duplicated``: the mean correlation
    of whether two of its species are duplicated, over trees that hold the clade; the share of trees
    with two like sisters of its species alone; mean and variation of the least distance between two
    copies over the tree's mean height; the mean share of its present species that are duplicated.
    ``nodes`` also has ``sample_id``; ``clades`` is ``clade, species``. 0 where there is nothing to tell.
    """
    from .trees import copy_distances, mirrored_sets, species_sets, tree_heights

    nodes = cut(nodes, "nodes")
    trees = nodes.select("sample_id", "tree_id").distinct()
    total = trees.groupBy("sample_id").agg(F.count("*").alias("trees"))
    copies = nodes.filter("is_leaf").groupBy("sample_id", "tree_id", F.col("label").alias("species")).agg(F.count("*").alias("n"))
    held = copies.join(clades, "species").withColumn("dup", (F.col("n") > 1).cast("long"))
    per = held.groupBy("sample_id", "tree_id", "clade").agg(F.avg("dup").alias("share"))
    duplicated = per.groupBy("sample_id", "clade").agg(F.avg("share").alias("duplicated"), F.count("*").alias("t"))
    doubled = held.filter("dup = 1").select("sample_id", "tree_id", "clade", "species")
    ones = doubled.groupBy("sample_id", "clade", "species").agg(F.count("*").alias("s1")).join(duplicated.select("sample_id", "clade", "t"), ["sample_id", "clade"]).filter("s1 < t")
    both = doubled.join(doubled.withColumnRenamed("species", "other"), ["sample_id", "tree_id", "clade"]).filter("species < other").groupBy("sample_id", "clade", "species", "other").agg(F.count("*").alias("both"))
    pairs = ones.join(ones.select("sample_id", "clade", F.col("species").alias("other"), F.col("s1").alias("s2")), ["sample_id", "clade"]).filter("species < other").join(both, ["sample_id", "clade", "species", "other"], "left")
    r = flag_correlation(F.col("t"), F.col("s1"), F.col("s2"), F.coalesce("both", F.lit(0)))
    synchrony = pairs.groupBy("sample_id", "clade").agg(F.avg(r).alias("synchrony"))
    every_set = cut(species_sets(nodes), "sets")
    sets = mirrored_sets(every_set).join(every_set.select("tree_id", "lo", "set"), ["tree_id", "lo"])
    inside = sets.select("tree_id", "lo", F.size("set").alias("size"), F.explode("set").alias("species")).join(clades, "species").groupBy("tree_id", "lo", "size", "clade").agg(F.count("*").alias("k")).filter("k = size")
    mirrored = inside.select("tree_id", "clade").distinct().join(trees, "tree_id").groupBy("sample_id", "clade").agg(F.count("*").alias("m")).join(total, "sample_id").select("sample_id", "clade", (F.col("m") / F.col("trees")).alias("mirrored"))
    tall = tree_heights(nodes).select("tree_id", "mean_height")
    apart = copy_distances(nodes).join(tall, "tree_id").join(trees, "tree_id").join(clades, "species").select("sample_id", "clade", F.try_divide("distance", "mean_height").alias("d"))
    age = apart.groupBy("sample_id", "clade").agg(F.avg("d").alias("divergence"), F.try_divide(F.stddev_pop("d"), F.avg("d")).alias("divergence_cv"))
    every = total.select("sample_id").join(clades.select("clade").distinct())
    out = every.join(synchrony, ["sample_id", "clade"], "left").join(mirrored, ["sample_id", "clade"], "left").join(age, ["sample_id", "clade"], "left").join(duplicated.drop("t"), ["sample_id", "clade"], "left")
    return out.na.fill(0.0)


def core_clusters(nodes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clusters of species with copies over a sample's trees: ``sample_id, multiset, core, n_copies, support``.

    ``nodes`` also has ``sample_id``; ``bounds`` is ``sample_id, species, bound``. A node with its parent's
    cluster is left out, copies are capped at the bounds, and clusters of one leaf or as many as all
    bounds are ignored. A cluster with a species of one copy is core and counts once a tree; others
    count by how often a tree has them.
    """
    from .trees import species_multisets

    trees = nodes.select("tree_id", "sample_id").distinct()
    sets = species_multisets(nodes)
    up = nodes.select("tree_id", "lo", "parent_lo").join(sets.select("tree_id", F.col("lo").alias("parent_lo"), F.col("multiset").alias("above")), ["tree_id", "parent_lo"], "left").select("tree_id", "lo", "above")
    own = sets.join(up, ["tree_id", "lo"]).filter("above is null or above <> multiset").join(trees, "tree_id")
    size = bounds.groupBy("sample_id").agg(F.sum("bound").alias("taxa"))
    members = own.select("sample_id", "tree_id", "lo", F.explode("multiset").alias("m")).select("sample_id", "tree_id", "lo", "m.species", "m.n").join(bounds, ["sample_id", "species"], "left")
    n = F.coalesce(F.least("n", "bound"), F.col("n"))
    capped = members.groupBy("sample_id", "tree_id", "lo").agg(F.sort_array(F.collect_list(F.struct("species", n.cast("long").alias("n")))).alias("multiset"), F.sum(n).alias("size"), F.max((F.col("bound") == 1).cast("int")).alias("core"))
    kept = capped.join(size, "sample_id").filter((F.col("size") > 1) & (F.col("size") != F.col("taxa")))
    per = kept.groupBy("sample_id", "tree_id", "multiset").agg(F.max("core").alias("core"), F.count("*").alias("k"))
    core = F.coalesce(F.col("core") == 1, F.lit(False))
    return per.groupBy("sample_id", "multiset", core.alias("core"), F.when(core, 1).otherwise(F.col("k")).alias("n_copies")).agg(F.count("*").alias("support"))


def copy_contrast(leaves: DataFrame) -> DataFrame:
    """How much more often two species are direct sisters where the first is duplicated than where it is single: ``sample_id, species, partner, share``."""
    kind = copies_per_tree(leaves).select("sample_id", "tree_id", "species", (F.col("n") > 1).alias("doubled"))
    total = kind.groupBy("sample_id", "species").agg(F.count(F.when(F.col("doubled"), 1)).alias("many"), F.count(F.when(~F.col("doubled"), 1)).alias("one"))
    met = sister_pairs(leaves).join(kind, ["sample_id", "tree_id", "species"]).groupBy("sample_id", "species", "partner").agg(F.count(F.when(F.col("doubled"), 1)).alias("a"), F.count(F.when(~F.col("doubled"), 1)).alias("b"))
    part = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return met.join(total, ["sample_id", "species"]).select("sample_id", "species", "partner", (part("a", "many") - part("b", "one")).alias("share"))


def cluster_support(multisets: DataFrame) -> DataFrame:
    """Clusters of species with copies and in how many nodes of the sample they are met; clusters of one species are left out."""
    return multisets.filter(F.size("multiset") > 1).groupBy("sample_id", "multiset").agg(F.count("*").alias("support"))


def filter_clusters(clusters: DataFrame, rule: str, value: float, floor: float | None = None) -> DataFrame:
    """Clusters at least as frequent as a threshold of their sample: constant, percentile, scaled median, or mean or median minus value std (population); no threshold is under ``floor``."""
    s = F.col("support")
    threshold: dict[str, Column] = {"constant": F.lit(float(value)), "percentile": F.percentile(s, value), "median": F.median(s) * value, "mean_std": F.avg(s) - value * F.stddev_pop(s), "median_std": F.median(s) - value * F.stddev_pop(s)}
    least = threshold[rule] if floor is None else F.greatest(threshold[rule], F.lit(float(floor)))
    bound = clusters.groupBy("sample_id").agg(F.count("*"), least.alias("threshold")).select("sample_id", "threshold")
    return clusters.join(bound, "sample_id").filter(s >= F.col("threshold"))


def polyploid_multiset(representative: DataFrame) -> DataFrame:
    """Each species repeated as often as it has copies."""
    return representative.select("sample_id", F.explode(F.array_repeat("species", F.col("copies").cast("int"))).alias("species"))


def propagate(members: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the leaf values below every inner node: ``members`` is ``tree_id, lo, species``, ``values`` ``species, value``."""
    return members.join(values, "species").groupBy("tree_id", "lo").agg(F.avg("value").alias("value"))


def copies_from_alignments(sequences: DataFrame) -> DataFrame:
    """Copies of each taxon per gene, from sequence names ``taxon_number`` (``gene, seq_id``; a name without a number is the taxon): ``gene, taxon, n``."""
    return sequences.groupBy("gene", F.regexp_replace("seq_id", r"_\d+$", "").alias("taxon")).agg(F.count("*").alias("n"))


def edge_vectors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The features of an edge's parent, of its child and its own in one array: ``sample_id, edge, vector``.

    ``edges`` is ``sample_id, edge, parent, child, features`` and ``nodes`` ``sample_id, node, features``, all
    of one width; a node without features counts as zeros of the width of the other end.
    """
    of = lambda end: nodes.select("sample_id", F.col("node").alias(end), F.col("features").alias(f"{end}_features"))
    rows = edges.join(of("parent"), ["sample_id", "parent"], "left").join(of("child"), ["sample_id", "child"], "left")
    zeros = lambda end, other: F.coalesce(f"{end}_features", F.transform(f"{other}_features", lambda x: x * 0))
    return rows.select("sample_id", "edge", F.concat(zeros("parent", "child"), zeros("child", "parent"), "features").alias("vector"))


def partner_ranks(matrix: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """How often a species' true partner is among its first 1 to k candidates by share (ties by name): ``sample_id, n, top1 .. topk``."""
    rank = F.row_number().over(W.partitionBy("sample_id", "species").orderBy(F.desc("share"), "partner"))
    met = truth.join(matrix.withColumn("rank", rank), ["sample_id", "species", "partner"], "left")
    return met.groupBy("sample_id").agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col("rank") <= i, F.lit(False)).cast("double")).alias(f"top{i}") for i in range(1, k + 1)))
