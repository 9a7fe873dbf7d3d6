"""Queries on shapes, copies and clusters of trees of any depth, and on what edge models get wrong (second forms of T, F, L, M and P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as P
from ..operators import features as X
from ..operators import labels as L
from ..operators import trees as T
from ..registry import query
from .event_queries import L8_EDGES, WIDE, wide_clades
from .label_queries import EDGES, edges
from .summary_queries import r, rounded
from .tree_queries import COPIES, FULL, leaves

N = "n AS MATERIALIZED (SELECT * FROM v_deep)"
TIPS = "tip AS MATERIALIZED (SELECT x.tree_id, x.lo AS leaf, x.label, (SELECT sum(u.dist) FROM n u WHERE u.tree_id = x.tree_id AND x.lo BETWEEN u.lo AND u.hi) AS far FROM n x WHERE x.is_leaf)"
PAIRS = f"{N}, {TIPS}, pairs AS MATERIALIZED (SELECT a.tree_id, a.label AS species, a.leaf AS x, b.leaf AS y, a.far + b.far - 2 * (SELECT sum(u.dist) FROM n u WHERE u.tree_id = a.tree_id AND u.lo < b.leaf AND u.lo <= a.leaf AND u.hi >= b.leaf) AS distance FROM tip a JOIN tip b ON a.tree_id = b.tree_id AND a.label = b.label AND a.leaf < b.leaf)"


@query("t3_edge_table", f"WITH {N} SELECT x.tree_id, row_number() OVER (PARTITION BY x.tree_id ORDER BY x.lo) - 1 AS edge_ix, x.lo, x.dist AS branch_length, (SELECT count(*) FROM n t WHERE t.tree_id = x.tree_id AND t.is_leaf AND t.lo BETWEEN x.lo AND x.hi) AS clade_size, x.depth FROM n x WHERE x.parent_lo IS NOT NULL")
def _(v):
    return T.edge_table(v.v_deep)


@query("t4_tree_heights_deep", f"WITH {N}, {TIPS} SELECT tree_id, {r('avg(far)', 'mean_height')}, {r('max(far)', 'height')}, max(far) - min(far) <= 1 AS ultrametric FROM tip GROUP BY tree_id")
def _(v):
    return rounded(T.tree_heights(v.v_deep))


@query("t5_scale", f"WITH {N} SELECT tree_id, lo, dist * 2.5 AS dist FROM n")
def _(v):
    return T.scale_lengths(v.v_deep, 2.5).select("tree_id", "lo", "dist")


@query("t14_copy_distances_deep", f"WITH {PAIRS} SELECT tree_id, species, min(distance) AS distance FROM pairs GROUP BY tree_id, species")
def _(v):
    return T.copy_distances(v.v_deep)


K3 = f"""WITH {PAIRS}, c AS (SELECT tree_id, label AS species, count(*) AS c FROM tip GROUP BY ALL), two AS (SELECT tree_id, species, arg_min([x, y], [-distance, x, y]) AS t FROM pairs GROUP BY ALL),
bothways AS (SELECT tree_id, species, x, y, distance FROM pairs UNION ALL SELECT tree_id, species, y, x, distance FROM pairs),
third AS (SELECT tree_id, species, arg_min(x, [-near, x]) AS leaf FROM (SELECT b.tree_id, b.species, b.x, min(b.distance) AS near FROM bothways b JOIN two ON two.tree_id = b.tree_id AND two.species = b.species AND list_contains(two.t, b.y) AND NOT list_contains(two.t, b.x) GROUP BY ALL) q GROUP BY ALL)
SELECT t.tree_id, t.label AS species, t.leaf FROM tip t JOIN c ON c.tree_id = t.tree_id AND c.species = t.label AND c.c <= 3 UNION ALL SELECT two.tree_id, two.species, unnest(two.t) FROM two JOIN c ON c.tree_id = two.tree_id AND c.species = two.species AND c.c > 3 UNION ALL SELECT third.tree_id, third.species, third.leaf FROM third JOIN c ON c.tree_id = third.tree_id AND c.species = third.species AND c.c > 3"""


@query("t10_diverse_leaves_three", K3)
def _(v):
    return T.diverse_leaves(v.v_deep, 3)


PRUNED = "SELECT tree_id, first, last, n, min(lo) AS lo, arg_max(label, lo) AS label, sum(dist) AS dist FROM (SELECT u.tree_id, u.lo, min(k.leaf) AS first, max(k.leaf) AS last, count(*) AS n, any_value(u.label) AS label, any_value(u.dist) AS dist FROM n u JOIN kept k ON k.tree_id = u.tree_id AND k.leaf BETWEEN u.lo AND u.hi GROUP BY u.tree_id, u.lo) q GROUP BY tree_id, first, last, n"


@query("t17_backbone", f"WITH {N}, kept AS (SELECT tree_id, label, min(lo) AS leaf FROM n WHERE is_leaf GROUP BY tree_id, label) {PRUNED}")
def _(v):
    return T.backbone(v.v_deep)


WIDE_NODES = "w AS MATERIALIZED (SELECT tree_id, 0 AS lo, max(hi) + 1 AS hi, CAST(NULL AS BIGINT) AS parent_lo, FALSE AS is_leaf, NULL AS label FROM n GROUP BY tree_id UNION ALL SELECT tree_id, 1, max(hi), 0, FALSE, NULL FROM n GROUP BY tree_id UNION ALL SELECT tree_id, lo + 1, lo + 1, 1, TRUE, label FROM n WHERE is_leaf UNION ALL SELECT tree_id, max(hi) + 1, max(hi) + 1, 0, TRUE, 'out' FROM n GROUP BY tree_id)"


@query("t9_repeated_in_polytomies", f"WITH {N}, {WIDE_NODES}, c AS (SELECT tree_id, label AS species, count(*) AS children, min(lo) AS kept FROM w WHERE parent_lo = 1 GROUP BY tree_id, label), g AS (SELECT tree_id FROM c GROUP BY tree_id HAVING max(children) > 1 AND count(*) > 1) SELECT c.tree_id, 1 AS lo, c.species, c.children, c.kept FROM c JOIN g ON g.tree_id = c.tree_id")
def _(v):
    """All leaves of a tree below one node, and one leaf beside it."""
    null, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    row = lambda lo, hi, up, leaf, label: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), up.cast("long").alias("parent_lo"), F.lit(leaf).alias("is_leaf"), label.alias("label"))
    root, end, lo = F.col("parent_lo").isNull(), F.col("hi"), F.col("lo")  # a root ends where its tree does
    rows = [F.when(root, row(F.lit(0), end + 1, null, False, text)), F.when(root, row(F.lit(1), end, F.lit(0), False, text)), F.when(root, row(end + 1, end + 1, F.lit(0), True, F.lit("out"))), F.when(F.col("is_leaf"), row(lo + 1, lo + 1, F.lit(1), True, F.col("label")))]
    wide = v.v_deep.select("tree_id", F.inline(F.array_compact(F.array(*rows))))
    return T.repeated_in_polytomies(wide.withColumns({"depth": F.lit(0), "dist": F.lit(1.0)}))


@query("f3_representative_with_absences", f"WITH dist AS ({FULL}), kinds AS (SELECT *, count(*) OVER (PARTITION BY sample_id, species) AS kinds FROM dist), smooth AS (SELECT k.sample_id, k.species, k.n, CASE WHEN kinds > 2 THEN sum(d.freq * (1 - abs(k.n - d.n) / 3.0)) ELSE max(k.freq) END AS peak FROM kinds k JOIN dist d ON k.sample_id = d.sample_id AND k.species = d.species AND abs(k.n - d.n) <= 2 GROUP BY k.sample_id, k.species, k.n, kinds) SELECT sample_id, species, greatest(n, 1) AS copies FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, species ORDER BY round(peak, 9) DESC, n) AS k FROM smooth) q WHERE k = 1")
def _(v):
    return X.representative_copies_with_absences(X.copies_per_tree(leaves(v)))


F10 = f"""WITH {PAIRS}, c AS MATERIALIZED (SELECT n.sample_id, n.tree_id, n.label AS species, count(*) AS n FROM n WHERE is_leaf GROUP BY ALL), h AS MATERIALIZED (SELECT c.*, k.clade, CASE WHEN c.n > 1 THEN 1 ELSE 0 END AS dup FROM c JOIN {WIDE} k ON k.species = c.species), tot AS (SELECT sample_id, count(DISTINCT tree_id) AS trees FROM n GROUP BY sample_id),
per AS (SELECT sample_id, clade, avg(s) AS duplicated, count(*) AS t FROM (SELECT sample_id, tree_id, clade, avg(dup) AS s FROM h GROUP BY ALL) q GROUP BY ALL),
col AS (SELECT sample_id, clade, species, sum(dup) AS s FROM h GROUP BY ALL),
syn AS (SELECT sample_id, clade, avg(r) AS synchrony FROM (SELECT a.sample_id, a.clade, (p.t * coalesce(b.k, 0) - a.s * z.s) / sqrt(CAST(p.t * a.s - a.s * a.s AS DOUBLE) * (p.t * z.s - z.s * z.s)) AS r FROM col a JOIN col z ON z.sample_id = a.sample_id AND z.clade = a.clade AND a.species < z.species JOIN per p ON p.sample_id = a.sample_id AND p.clade = a.clade LEFT JOIN (SELECT x.sample_id, x.clade, x.species, y.species AS other, count(*) AS k FROM h x JOIN h y ON y.tree_id = x.tree_id AND y.clade = x.clade AND x.dup = 1 AND y.dup = 1 AND x.species < y.species GROUP BY ALL) b ON b.sample_id = a.sample_id AND b.clade = a.clade AND b.species = a.species AND b.other = z.species WHERE a.s > 0 AND a.s < p.t AND z.s > 0 AND z.s < p.t) q GROUP BY ALL),
ss AS (SELECT u.tree_id, u.lo, u.parent_lo, list_sort(list_distinct(list(t.label))) AS labels FROM n u JOIN n t ON t.tree_id = u.tree_id AND t.is_leaf AND t.lo BETWEEN u.lo AND u.hi GROUP BY ALL),
mir AS (SELECT DISTINCT m.tree_id, k.clade FROM (SELECT tree_id, parent_lo, any_value(labels) AS labels FROM ss WHERE parent_lo IS NOT NULL GROUP BY tree_id, parent_lo HAVING count(*) = 2 AND count(DISTINCT labels) = 1) m, (SELECT clade, list(species) AS all_ FROM {WIDE} w GROUP BY clade) k WHERE list_has_all(k.all_, m.labels)),
mf AS (SELECT x.sample_id, m.clade, count(*) / max(tot.trees) AS mirrored FROM mir m JOIN (SELECT DISTINCT tree_id, sample_id FROM n) x ON x.tree_id = m.tree_id JOIN tot ON tot.sample_id = x.sample_id GROUP BY x.sample_id, m.clade),
ages AS (SELECT x.sample_id, k.clade, avg(d.distance / nullif(e.m, 0)) AS divergence, stddev_pop(d.distance / nullif(e.m, 0)) / nullif(avg(d.distance / nullif(e.m, 0)), 0) AS divergence_cv FROM (SELECT tree_id, species, min(distance) AS distance FROM pairs GROUP BY ALL) d JOIN (SELECT tree_id, avg(far) AS m FROM tip GROUP BY tree_id) e ON e.tree_id = d.tree_id JOIN (SELECT DISTINCT tree_id, sample_id FROM n) x ON x.tree_id = d.tree_id JOIN {WIDE} k ON k.species = d.species GROUP BY x.sample_id, k.clade)
SELECT e.sample_id, e.clade, {', '.join(r(f'coalesce({c}, 0)', c) for c in ('synchrony', 'mirrored', 'divergence', 'divergence_cv', 'duplicated'))} FROM (SELECT tot.sample_id, k.clade FROM tot, (SELECT DISTINCT clade FROM {WIDE} w) k) e LEFT JOIN syn USING (sample_id, clade) LEFT JOIN mf USING (sample_id, clade) LEFT JOIN ages USING (sample_id, clade) LEFT JOIN per USING (sample_id, clade)"""


@query("f10_detection_features", F10)
def _(v):
    return rounded(X.detection_features(v.v_deep, wide_clades(v)))


F16 = f"""WITH {N}, c AS MATERIALIZED (SELECT n.sample_id, u.tree_id, u.lo, u.parent_lo, n.label, count(*) AS k FROM n u JOIN n ON n.tree_id = u.tree_id AND n.is_leaf AND n.lo BETWEEN u.lo AND u.hi WHERE NOT u.is_leaf GROUP BY ALL),
b AS (SELECT sample_id, label, CAST(1 + hash_ AS BIGINT) AS bound FROM (SELECT DISTINCT sample_id, label, sample_id % 2 + CASE WHEN label < 'B' THEN 0 ELSE 1 END AS hash_ FROM n WHERE is_leaf) q),
f AS MATERIALIZED (SELECT c.sample_id, tree_id, lo, parent_lo, string_agg(concat(c.label, '*', k), ',' ORDER BY c.label) AS raw, string_agg(concat(c.label, '*', least(k, bound)), ',' ORDER BY c.label) AS multiset, sum(least(k, bound)) AS size, max(CASE WHEN bound = 1 THEN 1 ELSE 0 END) AS core FROM c JOIN b ON b.sample_id = c.sample_id AND b.label = c.label GROUP BY ALL),
t AS (SELECT sample_id, sum(bound) AS taxa FROM b GROUP BY ALL),
p AS (SELECT f.sample_id, f.tree_id, f.multiset, max(f.core) AS core, count(*) AS k FROM f LEFT JOIN f up ON up.tree_id = f.tree_id AND up.lo = f.parent_lo JOIN t ON t.sample_id = f.sample_id WHERE (up.raw IS NULL OR up.raw <> f.raw) AND f.size > 1 AND f.size <> t.taxa GROUP BY ALL)
SELECT sample_id, multiset, core = 1 AS core, CASE WHEN core = 1 THEN 1 ELSE k END AS n_copies, count(*) AS support FROM p GROUP BY ALL"""


@query("f16_core_clusters", F16)
def _(v):
    one = F.col("sample_id") % 2 + F.when(F.col("label") < "B", 0).otherwise(1) + 1
    bounds = v.v_deep.filter("is_leaf").select("sample_id", "label").distinct().select("sample_id", F.col("label").alias("species"), one.cast("long").alias("bound"))
    return X.core_clusters(v.v_deep, bounds).withColumn("multiset", F.array_join(F.transform("multiset", lambda x: F.concat(x["species"], F.lit("*"), x["n"].cast("string"))), ","))


@query("l12_copy_contrast", f"WITH k AS (SELECT sample_id, tree_id, species, n > 1 AS d FROM ({COPIES}) c), t AS (SELECT sample_id, species, count(CASE WHEN d THEN 1 END) AS many, count(CASE WHEN NOT d THEN 1 END) AS one FROM k GROUP BY ALL), s AS (SELECT DISTINCT a.sample_id, a.tree_id, a.species, b.species AS partner FROM v_leaves a JOIN v_leaves b ON a.tree_id = b.tree_id AND CAST(floor(a.pos / 2.0) AS BIGINT) = CAST(floor(b.pos / 2.0) AS BIGINT) AND a.species <> b.species) SELECT s.sample_id, s.species, s.partner, {r('coalesce(count(CASE WHEN k.d THEN 1 END) / nullif(max(t.many), 0), 0) - coalesce(count(CASE WHEN NOT k.d THEN 1 END) / nullif(max(t.one), 0), 0)', 'share')} FROM s JOIN k ON k.tree_id = s.tree_id AND k.species = s.species JOIN t ON t.sample_id = s.sample_id AND t.species = s.species GROUP BY s.sample_id, s.species, s.partner")
def _(v):
    return rounded(X.copy_contrast(leaves(v)))


@query("l6_scores_by_tag", f"WITH s AS (SELECT tree_id, avg(CAST(dist AS DOUBLE)) AS score, list_distinct(list(clade)) AS tags FROM v_leaves GROUP BY tree_id), w AS (SELECT sum(score) AS every, count(*) AS a FROM s), t AS (SELECT score, unnest(tags) AS tag FROM s) SELECT tag, count(*) AS n, {r('avg(score)', 'mean')}, {r('median(score)', 'median')}, {r('avg(score) - (max(every) - sum(score)) / nullif(max(a) - count(*), 0)', 'gap')} FROM t, w GROUP BY tag")
def _(v):
    samples = v.v_leaves.groupBy("tree_id").agg(F.avg(F.col("dist").cast("double")).alias("score"), F.collect_set("clade").alias("tags"))
    return rounded(L.scores_by_tag(samples.withColumnRenamed("tree_id", "sample_id")))


MODEL = f"(SELECT sample_id, edge, CASE WHEN edge >= 5 THEN n_regionkey END AS parent, (edge * 7 + sample_id) % 3 = 0 AS hit, CASE WHEN positive THEN 1 ELSE 0 END AS target FROM {L8_EDGES} q LEFT JOIN nation ON n_nationkey = edge - 5)"


@query("m5_relations_with_clades", f"WITH e AS MATERIALIZED (SELECT * FROM {MODEL} q), m AS MATERIALIZED (SELECT edge, list(species) AS s FROM {EDGES} q GROUP BY edge), f AS (SELECT * FROM e WHERE hit AND target = 0), k AS (SELECT f.sample_id, f.edge, min(CASE WHEN t.parent = f.edge THEN 0 WHEN f.parent = t.edge THEN 1 WHEN f.parent = t.parent THEN 2 WHEN len(a.s) > len(b.s) AND list_has_all(a.s, b.s) THEN 3 WHEN len(a.s) < len(b.s) AND list_has_all(b.s, a.s) THEN 4 ELSE 5 END) AS rk FROM f JOIN e t ON t.sample_id = f.sample_id AND t.target = 1 JOIN m a ON a.edge = f.edge JOIN m b ON b.edge = t.edge GROUP BY f.sample_id, f.edge) SELECT f.sample_id, f.edge, CASE rk WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'sibling' WHEN 3 THEN 'ancestor' WHEN 4 THEN 'descendant' WHEN 5 THEN 'scattered' ELSE 'no true edge' END AS relation FROM f LEFT JOIN k ON k.sample_id = f.sample_id AND k.edge = f.edge")
def _(v):
    own = edges(v)
    positive = v.v_truth_events.filter("event_ix % 4 = 0").join(v.nation, F.col("n_name") == F.col("target")).select("sample_id", (F.col("n_nationkey") + 5).alias("edge"), F.lit(1).alias("target")).distinct()
    grid = v.v_leaves.select("sample_id").distinct().join(own.select("edge").distinct()).join(positive, ["sample_id", "edge"], "left").na.fill(0, ["target"])
    up = v.nation.select((F.col("n_nationkey") + 5).alias("edge"), F.col("n_regionkey").alias("parent"))
    rows = grid.join(up, "edge", "left").withColumn("hit", (F.col("edge") * 7 + F.col("sample_id")) % 3 == 0)
    return L.false_positive_relations(rows, own)


GUESSES = "(SELECT sample_id, event_ix % 3 AS config, edge, CASE WHEN event_type = 'auto' THEN edge ELSE partner_key + 5 END AS partner, CASE event_ix % 4 WHEN 0 THEN edge WHEN 1 THEN partner_key + 5 ELSE (edge + event_ix) % 30 END AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, n_nationkey ORDER BY event_ix) AS k, n_nationkey + 5 AS edge FROM v_truth_events JOIN nation ON n_name = target) q WHERE k = 1)"


def guesses(v):
    """An edge per sample and target, with its partner and a predicted one."""
    from pyspark.sql import Window

    e = v.v_truth_events.join(v.nation, F.col("n_name") == F.col("target")).withColumn("k", F.row_number().over(Window.partitionBy("sample_id", "n_nationkey").orderBy("event_ix"))).filter("k = 1").withColumn("edge", F.col("n_nationkey") + 5)
    kind = F.col("event_ix") % 4
    return e.select("sample_id", (F.col("event_ix") % 3).alias("config"), "edge", F.when(F.col("event_type") == "auto", F.col("edge")).otherwise(F.col("partner_key") + 5).alias("partner"), F.when(kind == 0, F.col("edge")).when(kind == 1, F.col("partner_key") + 5).otherwise((F.col("edge") + F.col("event_ix")) % 30).alias("predicted"))


@query("m6_partner_accuracy", f"SELECT config, count(CASE WHEN partner = edge THEN 1 END) AS auto, {r('coalesce(count(CASE WHEN partner = edge AND predicted = partner THEN 1 END) / nullif(count(CASE WHEN partner = edge THEN 1 END), 0), 0)', 'auto_accuracy')}, count(CASE WHEN partner <> edge THEN 1 END) AS allo, {r('coalesce(count(CASE WHEN partner <> edge AND predicted = partner THEN 1 END) / nullif(count(CASE WHEN partner <> edge THEN 1 END), 0), 0)', 'allo_accuracy')} FROM {GUESSES} g GROUP BY config")
def _(v):
    return rounded(L.partner_accuracy(guesses(v)))


@query("m7_partner_summary", f"WITH g AS MATERIALIZED (SELECT * FROM {GUESSES} q) SELECT g.sample_id, count(*) AS n, {r('count(CASE WHEN g.predicted >= 5 THEN 1 END) / count(*)', 'tip_share')}, count(CASE WHEN b.predicted = g.edge AND g.edge <= g.predicted THEN 1 END) AS reciprocal FROM g LEFT JOIN g b ON b.sample_id = g.sample_id AND b.edge = g.predicted GROUP BY g.sample_id")
def _(v):
    return rounded(L.partner_summary(guesses(v), v.nation.select((F.col("n_nationkey") + 5).alias("edge"))))


@query("p2_section_names", "SELECT tree_id, regexp_replace(regexp_replace(newick, 'NATION_1[0-9]', 'sect_nov_B', 'g'), 'NATION_[0-9]+', 'NATION', 'g') AS newick FROM v_newick")
def _(v):
    return v.v_newick.select("tree_id", P.strip_after_underscore(F.regexp_replace("newick", "NATION_1([0-9])", "sect_nov_B_$1_x")).alias("newick"))


@query("p4_repaired_trees", "SELECT tree_id, replace(newick, ';', '') || CASE tree_id % 4 WHEN 0 THEN '' WHEN 1 THEN '7' WHEN 2 THEN '' ELSE '' END || ';' AS newick FROM v_newick")
def _(v):
    bare, kind = F.translate("newick", ";", ""), F.col("tree_id") % 4
    text = F.concat(bare, F.when(kind == 0, ":0;").when(kind == 1, "7:0;").when(kind == 2, ":1.5e-10;\x07").otherwise(""))
    return v.v_newick.select("tree_id", P.repair_tree(text).alias("newick"))


@query("p10_harmonised_names", "SELECT n_name || suffix AS name, n_name AS canonical FROM nation CROSS JOIN (VALUES ('0'), ('12'), ('345')) t(suffix) WHERE NOT EXISTS (SELECT 1 FROM nation x WHERE x.n_name <> nation.n_name AND starts_with(nation.n_name || suffix, x.n_name) AND length(x.n_name) > length(nation.n_name)) UNION SELECT lower(replace(n_name, '_', '')) || '0', n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM nation x WHERE x.n_name = nation.n_name || '0')")
def _(v):
    own = v.nation.select("n_name")
    longer = own.select(F.col("n_name").alias("other"))
    with_digits = own.select("n_name", F.explode(F.array(*(F.concat("n_name", F.lit(x)) for x in ("0", "12", "345")))).alias("name"))
    clear = with_digits.join(longer, F.col("name").startswith(F.col("other")) & (F.length("other") > F.length("n_name")), "left_anti").select("name")
    low = own.join(longer, F.col("other") == F.concat("n_name", F.lit("0")), "left_anti").select(F.concat(F.lower(F.translate("n_name", "_", "")), F.lit("0")).alias("name"))
    return P.harmonise(clear.unionByName(low), own.withColumnRenamed("n_name", "name"))
