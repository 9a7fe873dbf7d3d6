"""Events of whole-genome duplication in multi-labelled trees, and their labels on the edges of a species tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .greedy import greedy
from .lineage import cut
from .trees import leaves, mirrored_sets, species_sets

NAMES = "array<string>"


def decompose_events(nodes: DataFrame) -> DataFrame:
    """Events that explain the copies of a tree: ``tree_id, kind, clade, partner, at``.

    Auto: binary nodes whose children hold the same species, children before parents, unless a
    species is explained already (see `greedy`).
    Allo: each further copy of the other species, with the species beside it as partner (itself, if
    none). The copy that stays is the one whose neighbours are most like those of the backbone, the
    tree of first copies (the first on ties). ``at`` is the node or the copy.
    """
    sets = cut(species_sets(nodes).select("tree_id", "lo", "parent_lo", "set"), "sets")
    held = mirrored_sets(sets).join(sets.select("tree_id", "lo", "set"), ["tree_id", "lo"]).join(nodes.select("tree_id", "lo", "hi"), ["tree_id", "lo"])
    needed = held.select("tree_id", "lo", "hi", "set", F.explode("set").alias("species"))
    auto = cut(greedy(needed, ["tree_id", "lo"], ["tree_id", "species"], [F.col("hi"), F.desc("lo")], F.lit(1)).select("tree_id", "lo", "set").distinct(), "auto")
    explained = auto.select("tree_id", F.explode("set").alias("species"))
    tips = cut(leaves(nodes).select("tree_id", "leaf", "species", "parent_lo"), "tips")
    doubled = tips.groupBy("tree_id", "species").agg(F.count("*").alias("n"), F.min("leaf").alias("first")).filter("n > 1").join(explained, ["tree_id", "species"], "left_anti")
    inner = nodes.filter("not is_leaf").select("tree_id", F.col("lo").alias("up"), "hi")
    copies = tips.join(doubled.select("tree_id", "species"), ["tree_id", "species"])
    beside = copies.join(inner.withColumnRenamed("up", "parent_lo"), ["tree_id", "parent_lo"], "left").join(tips.select("tree_id", F.col("leaf").alias("x"), F.col("species").alias("other")), "tree_id").filter("x between parent_lo and hi and x <> leaf")
    around = copies.join(beside.groupBy("tree_id", "leaf").agg(F.collect_set("other").alias("beside")), ["tree_id", "leaf"], "left").withColumn("beside", F.coalesce("beside", F.array().cast(NAMES)))
    backbone = tips.groupBy("tree_id", "species").agg(F.min("leaf").alias("x")).select("tree_id", "x", F.col("species").alias("other"))
    over = doubled.select("tree_id", "species", "first").join(inner, "tree_id").filter("first between up and hi").join(backbone, "tree_id").filter("x between up and hi")
    sets = over.groupBy("tree_id", "species", "up").agg(F.collect_set("other").alias("all")).filter(F.size("all") > 1)
    expected = sets.groupBy("tree_id", "species").agg(F.max_by("all", "up").alias("expected"))
    own = F.array(F.col("species"))
    scored = around.join(expected, ["tree_id", "species"], "left").withColumn("score", F.coalesce(F.size(F.array_intersect(F.array_except("beside", own), F.array_except("expected", own))), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("tree_id", "species").orderBy(F.desc("score"), "leaf"))
    extra = scored.withColumn("rank", rank).filter("rank > 1")
    partner = F.when(F.size("beside") > 0, F.sort_array("beside")).otherwise(own)
    allo = extra.select("tree_id", F.lit("allo").alias("kind"), own.alias("clade"), partner.alias("partner"), F.col("leaf").alias("at"))
    return auto.select("tree_id", F.lit("auto").alias("kind"), F.col("set").alias("clade"), F.col("set").alias("partner"), F.col("lo").alias("at")).unionByName(allo)


def _sized(members: DataFrame, key: str, name: str) -> DataFrame:
    return members.withColumn(name, F.count("*").over(W.partitionBy(key)))


def event_parents(targets: DataFrame, true_tree: DataFrame, clades: DataFrame) -> DataFrame:
    """Both parents of each event's target: ``event, monophyletic, home, sibling`` (sets, null where there is none).

    ``targets`` is ``event, species``; ``clades`` are the edges of the inferred species tree, ``clade,
    species``; ``true_tree`` is ``node, parent, species``. home: the rest of the smallest clade that
    strictly holds the target (the lowest on ties); sibling: what is beside the target in the true
    tree, if it is a node's species set there; monophyletic: whether the target is one of the clades.
    """
    t = _sized(targets, "event", "nt")
    c = _sized(clades, "clade", "nc")
    shared = t.join(c, "species").groupBy("event", "clade").agg(F.count("*").alias("k"), F.max("nt").alias("nt"), F.max("nc").alias("nc")).filter("k = nt")
    smallest = shared.filter("nc > nt").groupBy("event").agg(F.min_by("clade", F.struct("nc", "clade")).alias("clade"))
    same = shared.filter("nc = nt").select("event", F.lit(True).alias("monophyletic")).distinct()
    rest = lambda d: d.join(targets, ["event", "species"], "left_anti").groupBy("event").agg(F.sort_array(F.collect_set("species")).alias("set"))
    home = rest(smallest.join(clades, "clade").select("event", "species")).withColumnRenamed("set", "home")
    n = _sized(true_tree, "node", "nn")
    node = t.join(n, "species").groupBy("event", "node").agg(F.count("*").alias("k"), F.max("nt").alias("nt"), F.max("nn").alias("nn"), F.max("parent").alias("parent")).filter("k = nt and nn = nt")
    above = node.filter("parent is not null").groupBy("event").agg(F.max_by("parent", "node").alias("node"))
    sibling = rest(above.join(true_tree.select("node", "species"), "node").select("event", "species")).withColumnRenamed("set", "sibling")
    every = targets.groupBy("event").agg(F.count("*").alias("size"))
    return every.join(same, "event", "left").join(home, "event", "left").join(sibling, "event", "left").withColumn("monophyletic", F.coalesce("monophyletic", F.lit(False)))


def away_partners(events: DataFrame, parents: DataFrame) -> DataFrame:
    """Partners of allo events moved to the parent away from home: ``event, partner, moved``.

    ``events`` is ``event, event_type, partner`` (a set). Where the home overlaps the labelled
    partner, the partner becomes the sibling in the true tree. An event without both, or whose
    target of several species is no clade, stays as it is, and so does an auto event.
    """
    can = (F.col("event_type") == "allo") & ((F.col("size") == 1) | F.col("monophyletic")) & F.col("home").isNotNull() & F.col("sibling").isNotNull()
    moved = F.coalesce(can & F.arrays_overlap("home", "partner"), F.lit(False))
    return events.join(parents, "event", "left").select("event", F.when(moved, F.col("sibling")).otherwise(F.sort_array("partner")).alias("partner"), moved.alias("moved"))


def label_audit(events: DataFrame, parents: DataFrame) -> DataFrame:
    """Where the home of allo targets lies: ``config, form`` (single or clade), ``n, monophyletic, home_is_partner, home_is_sibling, neither, no_sibling``.

    ``events`` also has ``config``. Events without partner or home are left out.
    """
    met = lambda c: F.coalesce(F.arrays_overlap("home", c), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    rows = events.filter("event_type = 'allo'").join(parents, "event").filter((F.size("partner") > 0) & F.col("home").isNotNull())
    by_partner, by_sibling = met("partner"), met("sibling")
    form = F.when(F.col("size") == 1, "single").otherwise("clade")
    return rows.groupBy("config", form.alias("form")).agg(F.count("*").alias("n"), n(F.col("monophyletic")).alias("monophyletic"), n(by_partner).alias("home_is_partner"), n(~by_partner & by_sibling).alias("home_is_sibling"), n(~by_partner & ~by_sibling).alias("neither"), n(F.col("sibling").isNull()).alias("no_sibling"))


def label_guards(observed: DataFrame, metadata: DataFrame, polyploids: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether samples and metadata belong together: ``sample_id, same_species, unknown_polyploids, same_edges, ok``.

    ``observed`` is ``sample_id, species, mode`` (most frequent copy number), ``metadata``
    ``sample_id, n_species``, ``polyploids`` the true ``sample_id, species``, and ``edges``
    ``sample_id, labels, features`` (numbers of edges). A null n_species is not held against a sample.
    """
    count = observed.groupBy("sample_id").agg(F.count_distinct("species").alias("kinds"))
    unknown = observed.filter("mode >= 2").join(polyploids, ["sample_id", "species"], "left_anti").groupBy("sample_id").agg(F.count("*").alias("unknown_polyploids"))
    rows = metadata.join(count, "sample_id", "left").join(unknown, "sample_id", "left").join(edges, "sample_id", "left")
    checked = rows.select("sample_id", F.coalesce(F.col("kinds") == F.col("n_species"), F.lit(True)).alias("same_species"), F.coalesce("unknown_polyploids", F.lit(0)).alias("unknown_polyploids"), F.coalesce(F.col("labels") == F.col("features"), F.lit(True)).alias("same_edges"))
    return checked.withColumn("ok", F.col("same_species") & (F.col("unknown_polyploids") == 0) & F.col("same_edges"))


def fragmented_clades(edges: DataFrame, members: DataFrame, least: float = 0.5) -> DataFrame:
    """Inner edges without an event whose tips have several: per sample ``signature, inward``.

    ``edges`` is ``sample_id, edge, positive, duplicated, partner`` and ``members`` ``edge, species``;
    an edge of one species is a tip. An edge counts if at least the share ``least`` of it is
    duplicated and two tips or more are positive; it points inward if two or more of these, and over
    half, have their partner among its tips.
    """
    size = members.groupBy("edge").agg(F.count("*").alias("size"))
    tips = members.join(size.filter("size = 1"), "edge").select("species", F.col("edge").alias("tip"))
    below = members.join(size.filter("size > 1"), "edge").join(tips, "species").select("edge", "tip")
    own = edges.join(size, "edge").filter((F.col("size") > 1) & ~F.col("positive") & (F.col("duplicated") >= least)).select("sample_id", "edge")
    met = own.join(below, "edge").join(edges.filter("positive").select("sample_id", F.col("edge").alias("tip"), "partner"), ["sample_id", "tip"])
    inside = below.select("edge", F.col("tip").alias("partner"), F.lit(1).alias("in"))
    per = met.join(inside, ["edge", "partner"], "left").groupBy("sample_id", "edge").agg(F.count("*").alias("tips"), F.count("in").alias("inward")).filter("tips > 1")
    found = per.groupBy("sample_id").agg(F.count("*").alias("signature"), F.count(F.when((F.col("inward") >= 2) & (2 * F.col("inward") > F.col("tips")), 1)).alias("inward"))
    return edges.select("sample_id").distinct().join(found, "sample_id", "left").na.fill(0)


def root_recovery(splits: DataFrame, truth: DataFrame, species: DataFrame) -> DataFrame:
    """Whether the most frequent basal split of each sample is the true one or its complement: ``sample_id, side, trees, recovered``.

    ``splits`` is ``sample_id, side`` (sorted sets, one row a tree), ``truth`` ``sample_id, side``, ``species``
    ``sample_id, species``. The split that sorts first wins a tie.
    """
    counted = splits.groupBy("sample_id", "side").agg(F.count("*").alias("trees"))
    best = counted.groupBy("sample_id").agg(F.min_by(F.struct("side", "trees"), F.struct((-F.col("trees")).alias("n"), "side")).alias("b")).select("sample_id", "b.*")
    every = species.groupBy("sample_id").agg(F.sort_array(F.collect_set("species")).alias("every"))
    same = (F.col("side") == F.col("true")) | (F.col("side") == F.sort_array(F.array_except("every", "true")))
    return best.join(truth.select("sample_id", F.col("side").alias("true")), "sample_id").join(every, "sample_id").select("sample_id", "side", "trees", same.alias("recovered"))


def placement_accuracy(truth: DataFrame, inferred: DataFrame, least: float = 0.5) -> DataFrame:
    """How near each polyploid of a true tree is placed to one of its true neighbours: ``tree_id, species, best, hit``.

    The species beside the first copy in the inferred tree are held against those beside each true
    copy by Jaccard similarity; the best counts, and is a hit from ``least`` on. Copies without
    another species beside them are left out. A tree is one row meanwhile, and leaves are compared
    within it, so trees are shuffled once.
    """

    def placed(nodes: DataFrame, name: str, wanted) -> DataFrame:
        """One row per tree: its ``wanted`` leaves with the set of species beside them."""
        tip, node = F.struct(F.col("lo").alias("leaf"), F.col("label").alias("species"), "parent_lo"), F.struct("lo", "hi")
        trees = nodes.groupBy("tree_id").agg(F.collect_list(F.when(F.col("is_leaf"), tip)).alias("tips"), F.collect_list(F.when(~F.col("is_leaf"), node)).alias("inner"))

        def row(t):
            up = F.get(F.filter("inner", lambda u: u["lo"] == t["parent_lo"]), F.lit(0))["hi"]
            near = F.filter("tips", lambda x: x["leaf"].between(t["parent_lo"], up) & (x["species"] != t["species"]))
            return F.struct(t["species"].alias("species"), F.array_distinct(F.transform(near, lambda x: x["species"])).alias("set"))

        mine = F.filter("tips", lambda t: wanted(t, F.filter("tips", lambda x: x["species"] == t["species"])))
        return trees.select("tree_id", F.filter(F.transform(mine, row), lambda r: F.size(r["set"]) > 0).alias(name))

    copies = placed(truth, "copies", lambda t, like: F.size(like) > 1)
    first = placed(inferred, "first", lambda t, like: F.array_min(F.transform(like, lambda x: x["leaf"])) == t["leaf"])
    rows = copies.join(first, "tree_id").select("tree_id", "first", F.inline("copies"))
    own = F.get(F.filter("first", lambda r: r["species"] == F.col("species")), F.lit(0))["set"]
    rows = rows.select("tree_id", "species", "set", own.alias("own")).filter("own is not null")
    both = F.size(F.array_intersect("set", "own"))
    best = rows.groupBy("tree_id", "species").agg(F.max(both / F.size(F.array_union("set", "own"))).alias("best"))
    return best.withColumn("hit", F.col("best") >= least)
