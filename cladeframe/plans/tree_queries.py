"""Tree, feature and cluster queries (S, T, F, K rows) over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import trees as T
from ..registry import query
from .summary_queries import r, rounded

PAIR = "CAST(floor(pos / 2.0) AS BIGINT)"


def leaves(v):
    return v.v_leaves.select("sample_id", "tree_id", "species", "clade", F.floor(F.col("pos") / 2).alias("parent_lo"))


COPIES = "SELECT sample_id, tree_id, species, count(*) AS n FROM v_leaves GROUP BY ALL"
DISTRIBUTION = f"SELECT sample_id, species, n, count(*) AS freq FROM ({COPIES}) c GROUP BY ALL"
TREES = "SELECT sample_id, count(DISTINCT tree_id) AS trees FROM v_leaves GROUP BY sample_id"
REPRESENTATIVE = f"""
WITH dist AS ({DISTRIBUTION}),
     kinds AS (SELECT *, count(*) OVER (PARTITION BY sample_id, species) AS kinds FROM dist),
     smooth AS (SELECT k.sample_id, k.species, k.n, CASE WHEN kinds > 2 THEN sum(d.freq * (1 - abs(k.n - d.n) / 3.0)) ELSE max(k.freq) END AS peak
                FROM kinds k JOIN dist d ON k.sample_id = d.sample_id AND k.species = d.species AND abs(k.n - d.n) <= 2 GROUP BY k.sample_id, k.species, k.n, kinds)
SELECT sample_id, species, n AS copies FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, species ORDER BY round(peak, 9) DESC, n) AS k FROM smooth) q WHERE k = 1"""


@query("s1_newick_corpus", "SELECT tree_id, sample_id, newick FROM v_newick")
def _(v):
    """Written as files of up to 1,000 trees, a folder per sample, and read back."""
    from ..operators.lineage import new_folder
    from ..sources.readers import read_newick

    path = new_folder(v.spark, "newick")
    lines = v.v_newick.select("sample_id", F.concat(F.col("tree_id").cast("string"), F.lit("\t"), "newick").alias("value"))
    lines.write.partitionBy("sample_id").option("maxRecordsPerFile", 1000).text(path)
    rows, cells = read_newick(v.spark, f"{path}/*"), F.split("newick", "\t")
    sample = F.regexp_extract("path", r"sample_id=(\d+)/", 1).cast("long")
    return rows.select(cells[0].cast("long").alias("tree_id"), sample.alias("sample_id"), F.concat(cells[1], F.lit(";")).alias("newick"))


@query("s2_parse_newick", "SELECT tree_id, lo, hi, depth, parent_lo, is_leaf, label, CASE WHEN depth = 0 THEN NULL ELSE dist END AS dist FROM v_nodes")
def _(v):
    return T.parse_newick(v.v_newick)


@query("t1_clade_members", "SELECT DISTINCT n.tree_id, n.lo, l.label AS species FROM v_nodes n JOIN v_nodes l ON n.tree_id = l.tree_id AND l.is_leaf AND l.lo BETWEEN n.lo AND n.hi WHERE NOT n.is_leaf")
def _(v):
    return T.clade_members(v.v_nodes)


@query("t2_depth_height", "SELECT tree_id, lo, depth, 2 - depth AS height FROM v_nodes")
def _(v):
    return T.with_height(v.v_nodes).select("tree_id", "lo", "depth", "height")


@query("t4_tree_heights", f"SELECT tree_id, {r('avg(dist + 1)', 'mean_height')}, {r('max(dist + 1)', 'height')}, max(dist) - min(dist) <= 1 AS ultrametric FROM v_leaves GROUP BY tree_id")
def _(v):
    return rounded(T.tree_heights(v.v_nodes))


@query("t5_rescale", "SELECT n.tree_id, lo, round(n.dist / tall, 6) AS dist FROM v_nodes n JOIN (SELECT tree_id, max(dist + 1) AS tall FROM v_leaves GROUP BY tree_id) h ON n.tree_id = h.tree_id")
def _(v):
    return rounded(T.rescale_to_height(v.v_nodes).select("tree_id", "lo", F.col("dist").cast("double").alias("dist")))


@query("t7_species_multisets", "SELECT tree_id, lo, string_agg(concat(species, '*', n), ',' ORDER BY species) AS multiset FROM (SELECT n.tree_id, n.lo, l.label AS species, count(*) AS n FROM v_nodes n JOIN v_nodes l ON n.tree_id = l.tree_id AND l.is_leaf AND l.lo BETWEEN n.lo AND n.hi WHERE NOT n.is_leaf GROUP BY ALL) m GROUP BY tree_id, lo")
def _(v):
    return T.species_multisets(v.v_nodes).select("tree_id", "lo", F.array_join(F.transform("multiset", lambda x: F.concat(x["species"], F.lit("*"), x["n"].cast("string"))), ",").alias("multiset"))


@query("t11_basal_splits", f"SELECT tree_id, side FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY n, side) AS k FROM (SELECT tree_id, {PAIR} AS p, count(*) AS n, string_agg(DISTINCT species, ',' ORDER BY species) AS side FROM v_leaves GROUP BY tree_id, {PAIR}) s) q WHERE k = 1")
def _(v):
    return T.basal_splits(v.v_nodes).select("tree_id", F.array_join("side", ",").alias("side"))


@query("t11_consensus_split", f"SELECT side, count(*) AS trees FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY n, side) AS k FROM (SELECT tree_id, {PAIR} AS p, count(*) AS n, string_agg(DISTINCT species, ',' ORDER BY species) AS side FROM v_leaves GROUP BY tree_id, {PAIR}) s) q WHERE k = 1 GROUP BY side ORDER BY trees DESC, side LIMIT 1")
def _(v):
    return T.consensus_split(T.basal_splits(v.v_nodes)).select(F.array_join("side", ",").alias("side"), "trees")


@query("t12_sister_species", f"SELECT DISTINCT a.tree_id, a.species AS a, b.species AS b FROM v_leaves a JOIN v_leaves b ON a.tree_id = b.tree_id AND CAST(floor(a.pos / 2.0) AS BIGINT) = CAST(floor(b.pos / 2.0) AS BIGINT) AND a.species < b.species")
def _(v):
    return T.sister_species(v.v_nodes)


@query("t13_sibling_sets", f"WITH p AS (SELECT DISTINCT tree_id, {PAIR} AS k, species FROM v_leaves), a AS (SELECT DISTINCT x.tree_id, x.k, y.species FROM p x JOIN p y ON x.tree_id = y.tree_id AND x.k <> y.k) SELECT a.tree_id, 1 + 3 * a.k AS lo, string_agg(a.species, ',' ORDER BY a.species) AS siblings FROM a LEFT JOIN p ON a.tree_id = p.tree_id AND a.k = p.k AND a.species = p.species WHERE p.species IS NULL GROUP BY a.tree_id, a.k")
def _(v):
    return T.sibling_sets(v.v_nodes.filter("depth < 2 or is_leaf")).join(v.v_nodes.filter("depth = 1").select("tree_id", "lo"), ["tree_id", "lo"]).select("tree_id", "lo", F.array_join("siblings", ",").alias("siblings"))


@query("t14_copy_distances", "SELECT a.tree_id, a.species, min(CASE WHEN CAST(floor(a.pos / 2.0) AS BIGINT) = CAST(floor(b.pos / 2.0) AS BIGINT) THEN a.dist + b.dist ELSE a.dist + b.dist + 2 END) AS distance FROM v_leaves a JOIN v_leaves b ON a.tree_id = b.tree_id AND a.species = b.species AND a.pos < b.pos GROUP BY a.tree_id, a.species")
def _(v):
    return T.copy_distances(v.v_nodes)


@query("t15_mirrored_nodes", f"WITH s AS (SELECT tree_id, {PAIR} AS k, string_agg(DISTINCT species, ',' ORDER BY species) AS side FROM v_leaves GROUP BY tree_id, {PAIR}), w AS (SELECT tree_id, count(*) AS n, min(side) AS a, max(side) AS b FROM s GROUP BY tree_id) SELECT tree_id, 0 AS lo FROM w WHERE n = 2 AND a = b UNION ALL SELECT tree_id, 1 + 3 * k FROM (SELECT tree_id, {PAIR} AS k, count(*) AS n, count(DISTINCT species) AS kinds FROM v_leaves GROUP BY tree_id, {PAIR}) q WHERE n = 2 AND kinds = 1")
def _(v):
    return T.mirrored_nodes(v.v_nodes)


@query("t16_collapse_identical", f"WITH p AS (SELECT tree_id, {PAIR} AS k, string_agg(species, '+' ORDER BY species) AS pair FROM v_leaves GROUP BY tree_id, {PAIR}), t AS (SELECT tree_id, string_agg(pair, '/' ORDER BY pair) AS code FROM p GROUP BY tree_id) SELECT min(tree_id) AS tree_id, count(*) AS n_trees FROM t GROUP BY code")
def _(v):
    return T.collapse_identical(v.v_nodes)


@query("t9_single_species_clades", f"WITH p AS (SELECT tree_id, {PAIR} AS k, count(*) AS n, count(DISTINCT species) AS kinds, min(species) AS species, min(pos) AS pos FROM v_leaves GROUP BY tree_id, {PAIR}), w AS (SELECT tree_id, count(*) AS n, count(DISTINCT species) AS kinds, min(species) AS species FROM v_leaves GROUP BY tree_id) SELECT tree_id, 0 AS lo, species, n AS copies, 2 AS kept FROM w WHERE n >= 2 AND kinds = 1 UNION ALL SELECT p.tree_id, 1 + 3 * k, p.species, p.n, 2 + 3 * k FROM p JOIN w ON p.tree_id = w.tree_id WHERE p.n >= 2 AND p.kinds = 1 AND NOT (w.n >= 2 AND w.kinds = 1)")
def _(v):
    return T.single_species_clades(v.v_nodes)


@query("t17_prune", f"WITH l AS (SELECT tree_id, {PAIR} AS k, 2 + 3 * {PAIR} + pos % 2 AS leaf, species, dist FROM v_leaves WHERE species IN (SELECT n_name FROM nation WHERE n_regionkey < 2)), n AS (SELECT tree_id, leaf AS lo, leaf AS first, leaf AS last, 1 AS n, species AS label, dist FROM l UNION ALL SELECT tree_id, 1 + 3 * k, min(leaf), max(leaf), count(*), NULL, 1.0 FROM l GROUP BY tree_id, k UNION ALL SELECT tree_id, 0, min(leaf), max(leaf), count(*), NULL, 0.0 FROM l GROUP BY tree_id) SELECT tree_id, first, last, n, min(lo) AS lo, arg_max(label, lo) AS label, sum(dist) AS dist FROM n GROUP BY tree_id, first, last, n")
def _(v):
    return T.prune(v.v_nodes, v.nation.filter("n_regionkey < 2").select(F.col("n_name").alias("species"))).withColumn("dist", F.col("dist").cast("double"))


@query("f1_copies_per_tree", COPIES)
def _(v):
    return X.copies_per_tree(leaves(v))


@query("f2_copy_distribution", DISTRIBUTION)
def _(v):
    return X.copy_distribution(X.copies_per_tree(leaves(v)))


def representative(v):
    """From tree text: parse, count, smooth."""
    nodes = T.parse_newick(v.v_newick)
    own = T.leaves(nodes).join(v.v_newick.select("tree_id", "sample_id"), "tree_id")
    return X.representative_copies(X.copy_distribution(X.copies_per_tree(own)))


@query("f3_representative_copies", REPRESENTATIVE)
def _(v):
    return representative(v)


@query("k2_multiset", f"SELECT sample_id, species FROM ({REPRESENTATIVE}) q, range(100) g(i) WHERE g.i < copies")
def _(v):
    return X.polyploid_multiset(X.representative_copies(X.copy_distribution(X.copies_per_tree(leaves(v)))))


@query("f4_consensus_bound", f"SELECT sample_id, species, greatest(coalesce(max(CASE WHEN 2 * reach >= trees THEN n END), 0), 1) AS bound FROM (SELECT *, sum(freq) OVER (PARTITION BY sample_id, species ORDER BY n DESC) AS reach FROM ({DISTRIBUTION}) d) q JOIN ({TREES}) t USING (sample_id) GROUP BY sample_id, species")
def _(v):
    return X.consensus_bound(X.copies_per_tree(leaves(v)))


FULL = f"SELECT sample_id, species, n, freq FROM ({DISTRIBUTION}) d UNION ALL SELECT sample_id, species, 0, trees - met FROM (SELECT sample_id, species, CAST(sum(freq) AS BIGINT) AS met FROM ({DISTRIBUTION}) d GROUP BY ALL) s JOIN ({TREES}) t USING (sample_id) WHERE trees > met"


@query("f5_copy_features", f"SELECT sample_id, species, {r('sum(n * freq) / sum(freq)', 'mean')}, {r('sum(n * n * freq) / sum(freq) - (sum(n * freq) / sum(freq)) * (sum(n * freq) / sum(freq))', 'variance')}, arg_min(n, freq * -1000 + n) AS mode, {', '.join(r(f'sum(CASE WHEN {c} THEN freq ELSE 0 END) / sum(freq)', k) for k, c in (('p0', 'n = 0'), ('p1', 'n = 1'), ('p2', 'n = 2'), ('p3', 'n >= 3')))}, max(n) AS most FROM ({FULL}) f GROUP BY sample_id, species")
def _(v):
    return rounded(X.copy_features(X.copies_per_tree(leaves(v))))


SISTERS = f"SELECT DISTINCT a.sample_id, a.tree_id, a.species, b.species AS partner FROM v_leaves a JOIN v_leaves b ON a.tree_id = b.tree_id AND CAST(floor(a.pos / 2.0) AS BIGINT) = CAST(floor(b.pos / 2.0) AS BIGINT) AND a.species <> b.species"
MATRIX = f"SELECT sample_id, species, partner, count(*) / max(trees) AS share FROM ({SISTERS}) s JOIN ({TREES}) t USING (sample_id) GROUP BY sample_id, species, partner"


@query("f7_coclustering", f"SELECT sample_id, species, partner, {r('share', 'share')} FROM ({MATRIX}) m")
def _(v):
    return rounded(X.coclustering(leaves(v)))


@query("f7_coclustering_duplicated", f"WITH d AS (SELECT sample_id, tree_id, species FROM ({COPIES}) c WHERE n >= 2), t AS (SELECT sample_id, species, count(*) AS total FROM d GROUP BY ALL) SELECT s.sample_id, s.species, s.partner, round(count(*) / max(t.total), 6) AS share FROM ({SISTERS}) s JOIN d ON s.tree_id = d.tree_id AND s.species = d.species JOIN t ON t.sample_id = s.sample_id AND t.species = s.species GROUP BY s.sample_id, s.species, s.partner")
def _(v):
    return rounded(X.coclustering(leaves(v), True))


@query("f6_profile_summary", f"WITH sp AS (SELECT DISTINCT sample_id, species FROM v_leaves), m AS (SELECT sample_id, species, partner, count(*) AS k FROM ({SISTERS}) s GROUP BY sample_id, species, partner), g AS (SELECT a.sample_id, a.species, coalesce(m.k, 0) AS k, max(CASE WHEN m.k IS NULL THEN 1 ELSE t.trees END) OVER (PARTITION BY a.sample_id, a.species) AS t FROM sp a JOIN sp b ON a.sample_id = b.sample_id AND a.species <> b.species JOIN ({TREES}) t ON t.sample_id = a.sample_id LEFT JOIN m ON m.sample_id = a.sample_id AND m.species = a.species AND m.partner = b.species) SELECT sample_id, species, {r('sum(k) / (count(*) * max(t))', 'mean')}, {r('sqrt(CAST(count(*) * sum(k * k) - sum(k) * sum(k) AS DOUBLE)) / (count(*) * max(t))', 'std')}, {r('max(k) / max(t)', 'max')}, {r('min(k) / max(t)', 'min')}, {r('quantile_cont(k, 0.5) / max(t)', 'median')} FROM g GROUP BY sample_id, species")
def _(v):
    own = leaves(v)
    return rounded(X.profile_summary(X.sister_counts(own), own.select("sample_id", "species").distinct()))


@query("f8_effective_partners", f"SELECT sample_id, species, round(sum(share) * sum(share) / sum(share * share), 5) AS n_eff FROM ({MATRIX}) m GROUP BY sample_id, species")
def _(v):
    return X.effective_partners(X.coclustering(leaves(v))).withColumn("n_eff", F.round("n_eff", 5))


CLADES = "SELECT n_name AS species, r_name AS clade FROM nation JOIN region ON n_regionkey = r_regionkey"


def clades(v):
    return v.nation.join(F.broadcast(v.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("species"), F.col("r_name").alias("clade"))


@query("f9_clade_coclustering", f"WITH c AS ({CLADES}), z AS (SELECT clade, count(*) AS size FROM c GROUP BY clade) SELECT sample_id, a.clade, b.clade AS other, {r('sum(share) / (max(za.size) * max(zb.size))', 'mean')}, {r('max(share)', 'max')} FROM ({MATRIX}) m JOIN c a ON m.species = a.species JOIN c b ON m.partner = b.species JOIN z za ON za.clade = a.clade JOIN z zb ON zb.clade = b.clade GROUP BY sample_id, a.clade, b.clade")
def _(v):
    return rounded(X.clade_coclustering(X.coclustering(leaves(v)), clades(v)))


@query("f10_duplication_synchrony", f"WITH f AS (SELECT sample_id, tree_id, species FROM ({COPIES}) c WHERE n >= 2), sp AS (SELECT DISTINCT sample_id, species FROM v_leaves), o AS (SELECT sp.sample_id, sp.species, count(f.tree_id) AS s FROM sp LEFT JOIN f ON f.sample_id = sp.sample_id AND f.species = sp.species GROUP BY sp.sample_id, sp.species), b AS (SELECT x.sample_id, x.species, y.species AS partner, count(*) AS k FROM f x JOIN f y ON x.tree_id = y.tree_id AND x.species < y.species GROUP BY ALL) SELECT sample_id, species, partner, round(CASE WHEN spread > 0 THEN (t * k - s * s2) / spread END, 6) AS r FROM (SELECT o.sample_id, o.species, p.species AS partner, o.s, p.s AS s2, coalesce(b.k, 0) AS k, trees AS t, sqrt(CAST(trees * o.s - o.s * o.s AS DOUBLE) * (trees * p.s - p.s * p.s)) AS spread FROM o JOIN o p ON o.sample_id = p.sample_id AND o.species < p.species JOIN ({TREES}) tr ON tr.sample_id = o.sample_id LEFT JOIN b ON b.sample_id = o.sample_id AND b.species = o.species AND b.partner = p.species) q")
def _(v):
    return rounded(X.duplication_synchrony(X.copies_per_tree(leaves(v))))


@query("f12_clade_summaries", f"WITH p AS (SELECT c.sample_id, c.tree_id, k.clade, count(*) AS kinds, sum(n) AS inside, count(CASE WHEN n >= 2 THEN 1 END) AS doubled, sum(n * n) AS squares FROM ({COPIES}) c JOIN ({CLADES}) k USING (species) GROUP BY ALL), w AS (SELECT *, (sum(inside) OVER (PARTITION BY tree_id) - inside) / nullif(sum(kinds) OVER (PARTITION BY tree_id) - kinds, 0) AS outer_ FROM p) SELECT sample_id, clade, {r('avg(CASE WHEN doubled > 0 THEN 1.0 ELSE 0.0 END)', 'duplication')}, {r('avg(inside - kinds)', 'extra')}, {r('avg(inside / kinds)', 'per_species')}, {r('avg(doubled / kinds)', 'coherence')}, {r('avg(inside / kinds / outer_)', 'in_out')}, {r('avg(CASE WHEN size > 1 THEN sqrt((size * squares - inside * inside) / (size * (size - 1))) * size / inside END)', 'variation')} FROM w JOIN (SELECT clade AS z, count(*) AS size FROM ({CLADES}) y GROUP BY clade) zz ON z = clade GROUP BY sample_id, clade")
def _(v):
    return rounded(X.clade_summaries(leaves(v).drop("clade"), clades(v)))


CLUSTERS = f"SELECT sample_id, multiset, count(*) AS support FROM (SELECT sample_id, tree_id, {PAIR} AS k, CASE WHEN count(*) = 1 OR min(species) = max(species) THEN concat(min(species), '*', count(*)) ELSE concat(min(species), '*1,', max(species), '*1') END AS multiset, count(DISTINCT species) AS kinds FROM v_leaves GROUP BY ALL) m WHERE kinds > 1 GROUP BY ALL"


def clusters(v):
    nodes = v.v_nodes.filter("depth > 0")
    sets = T.species_multisets(nodes).join(v.v_newick.select("tree_id", "sample_id"), "tree_id")
    return X.cluster_support(sets)


def flat(df):
    return df.withColumn("multiset", F.array_join(F.transform("multiset", lambda x: F.concat(x["species"], F.lit("*"), x["n"].cast("string"))), ","))


@query("f16_cluster_support", CLUSTERS)
def _(v):
    return flat(clusters(v))


for _rule, _value, _sql in (("constant", 3, "3"), ("percentile", 0.9, "quantile_cont(support, 0.9)"), ("median", 2.0, "median(support) * 2"), ("mean_std", 0.5, "avg(support) - 0.5 * stddev_pop(support)")):

    @query(f"f17_filter_{_rule}", f"SELECT c.sample_id, multiset, support, {r('threshold', 'threshold')} FROM ({CLUSTERS}) c JOIN (SELECT sample_id, CAST({_sql} AS DOUBLE) AS threshold FROM ({CLUSTERS}) d GROUP BY sample_id) t ON c.sample_id = t.sample_id WHERE support >= threshold")
    def _(v, rule=_rule, value=_value):
        return rounded(flat(X.filter_clusters(clusters(v), rule, value)))


SIDES = f"WITH w AS (SELECT tree_id, count(*) AS n, count(DISTINCT species) AS kinds, list_sort(list(species)) AS whole FROM v_leaves GROUP BY tree_id), s AS (SELECT tree_id, {PAIR} AS k, list_sort(list(species)) AS own FROM v_leaves GROUP BY tree_id, {PAIR}), x AS (SELECT s.tree_id, own, list_sort(list_filter(whole, lambda e: NOT list_contains(own, e))) AS rest FROM s JOIN w ON s.tree_id = w.tree_id WHERE n = kinds) SELECT DISTINCT tree_id, array_to_string(CASE WHEN len(own) < len(rest) THEN own WHEN len(own) > len(rest) THEN rest ELSE least(own, rest) END, ',') AS side FROM x WHERE len(own) > 1 AND len(rest) > 1"


@query("t8_bipartitions", SIDES)
def _(v):
    return T.bipartitions(v.v_nodes)


@query("t8_robinson_foulds", f"WITH b AS (SELECT tree_id % 40 AS key, q.* FROM ({SIDES}) q), ref AS (SELECT key, min(tree_id) AS t FROM b GROUP BY key), r AS (SELECT b.key, b.side FROM b JOIN ref ON b.key = ref.key AND b.tree_id = ref.t), n AS (SELECT key, tree_id, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT key, count(*) AS m FROM r GROUP BY key), s AS (SELECT b.tree_id, count(*) AS shared FROM b JOIN r ON b.key = r.key AND b.side = r.side GROUP BY b.tree_id) SELECT n.tree_id, n + m - 2 * coalesce(shared, 0) AS rf, {r('(n + m - 2 * coalesce(shared, 0)) / (n + m)', 'normalised')} FROM n JOIN m ON n.key = m.key LEFT JOIN s ON s.tree_id = n.tree_id")
def _(v):
    own = T.bipartitions(v.v_nodes).withColumn("key", F.col("tree_id") % 40)
    first = own.groupBy("key").agg(F.min("tree_id").alias("tree_id"))
    return rounded(T.robinson_foulds(own, own.join(first, ["key", "tree_id"]).select("key", "side")))


@query("t3_concordance", f"WITH c AS ({CLADES}), a AS (SELECT DISTINCT tree_id, species FROM v_leaves), i AS (SELECT a.tree_id, k.clade, count(CASE WHEN c.clade = k.clade THEN 1 END) AS inside, count(CASE WHEN c.clade <> k.clade THEN 1 END) AS outside, string_agg(CASE WHEN c.clade = k.clade THEN a.species END, ',' ORDER BY a.species) AS want, string_agg(CASE WHEN c.clade <> k.clade THEN a.species END, ',' ORDER BY a.species) AS rest FROM a JOIN c ON a.species = c.species CROSS JOIN (SELECT DISTINCT clade FROM c) k GROUP BY a.tree_id, k.clade), g AS (SELECT * FROM i WHERE inside > 1 AND outside > 0), h AS (SELECT tree_id, string_agg(DISTINCT species, ',' ORDER BY species) AS key FROM v_leaves GROUP BY tree_id, {PAIR} UNION SELECT tree_id, species FROM v_leaves UNION SELECT tree_id, string_agg(DISTINCT species, ',' ORDER BY species) FROM v_leaves GROUP BY tree_id) SELECT g.clade, count(*) AS informative, round(count(CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.tree_id = g.tree_id AND (h.key = g.want OR h.key = g.rest)) THEN 1 END) / count(*), 6) AS concordance FROM g GROUP BY g.clade")
def _(v):
    return rounded(T.concordance(v.v_nodes, clades(v)))


@query("t10_diverse_leaves", "SELECT tree_id, species, 2 + CAST(floor(pos / 2.0) AS BIGINT) * 3 + pos % 2 AS leaf FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, species ORDER BY dist DESC, pos) AS k FROM v_leaves) q WHERE k = 1")
def _(v):
    return T.diverse_leaves(v.v_nodes)
