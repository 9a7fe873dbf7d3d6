"""Queries on events, their labels and the places of copies (the rest of the N, T, F and L rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import features as X
from ..operators import topology as Y
from ..operators import trees as T
from ..operators.lineage import cut
from ..registry import query
from .label_queries import EDGES, TARGETS, edges, targets
from .summary_queries import r, rounded
from .tree_queries import COPIES, FULL, MATRIX, leaves

JOINED = "list_distinct(list(label))"
SPECIES_SETS = "n AS MATERIALIZED (SELECT * FROM v_deep), s AS MATERIALIZED (SELECT n.tree_id, n.lo, n.hi, n.parent_lo, list_sort(list_distinct(list(t.label))) AS labels FROM n JOIN n t ON t.tree_id = n.tree_id AND t.is_leaf AND t.lo BETWEEN n.lo AND n.hi GROUP BY ALL)"
N10 = f"""WITH RECURSIVE {SPECIES_SETS},
m AS (SELECT p.tree_id, p.lo, p.hi, p.labels FROM s p JOIN s c ON c.tree_id = p.tree_id AND c.parent_lo = p.lo GROUP BY ALL HAVING count(*) = 2 AND count(DISTINCT c.labels) = 1),
o AS (SELECT tree_id, list(lo ORDER BY hi, -lo) AS los, list(labels ORDER BY hi, -lo) AS sets FROM m GROUP BY tree_id),
g AS (SELECT tree_id, los, sets, 0 AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS taken FROM o UNION ALL SELECT tree_id, los, sets, i + 1, CASE WHEN list_has_any(used, sets[i + 1]) THEN used ELSE list_concat(used, sets[i + 1]) END, CASE WHEN list_has_any(used, sets[i + 1]) THEN taken ELSE list_append(taken, los[i + 1]) END FROM g WHERE i < len(los)),
auto AS (SELECT m.tree_id, m.lo, m.labels FROM m JOIN g ON g.tree_id = m.tree_id AND g.i = len(g.los) AND list_contains(g.taken, m.lo)),
tip AS (SELECT tree_id, lo AS leaf, label, parent_lo FROM n WHERE is_leaf),
d AS (SELECT tree_id, label, min(leaf) AS first FROM tip t WHERE NOT EXISTS (SELECT 1 FROM auto a WHERE a.tree_id = t.tree_id AND list_contains(a.labels, t.label)) GROUP BY ALL HAVING count(*) > 1),
bone AS (SELECT tree_id, label, min(leaf) AS leaf FROM tip GROUP BY ALL),
over AS (SELECT d.tree_id, d.label, u.lo, list(b.label) AS labels FROM d JOIN n u ON u.tree_id = d.tree_id AND NOT u.is_leaf AND d.first BETWEEN u.lo AND u.hi JOIN bone b ON b.tree_id = d.tree_id AND b.leaf BETWEEN u.lo AND u.hi GROUP BY ALL HAVING count(*) > 1),
want AS (SELECT tree_id, label, arg_max(labels, lo) AS labels FROM over GROUP BY ALL),
near AS (SELECT c.tree_id, c.label, c.leaf, list_sort(list_distinct(list(x.label) FILTER (x.label IS NOT NULL))) AS beside FROM tip c JOIN d ON d.tree_id = c.tree_id AND d.label = c.label LEFT JOIN n u ON u.tree_id = c.tree_id AND u.lo = c.parent_lo LEFT JOIN tip x ON x.tree_id = c.tree_id AND x.leaf BETWEEN u.lo AND u.hi AND x.leaf <> c.leaf GROUP BY c.tree_id, c.label, c.leaf),
ranked AS (SELECT near.*, row_number() OVER (PARTITION BY near.tree_id, near.label ORDER BY len(list_filter(list_intersect(beside, coalesce(w.labels, [])), lambda x: x <> near.label)) DESC, leaf) AS k FROM near LEFT JOIN want w ON w.tree_id = near.tree_id AND w.label = near.label)
SELECT tree_id, 'auto' AS kind, array_to_string(labels, ',') AS clade, array_to_string(labels, ',') AS partner, lo AS at FROM auto
UNION ALL SELECT tree_id, 'allo', label, CASE WHEN len(beside) > 0 THEN array_to_string(beside, ',') ELSE label END, leaf FROM ranked WHERE k > 1"""


@query("n10_decompose_events", N10)
def _(v):
    return E.decompose_events(v.v_deep).withColumns({"clade": F.array_join("clade", ","), "partner": F.array_join("partner", ",")})


WIDE = "(SELECT r_regionkey AS clade, r_name AS species FROM region UNION ALL SELECT 5, r_name FROM region WHERE r_regionkey < 2 UNION ALL SELECT 6, r_name FROM region WHERE r_regionkey >= 2)"


def wide_clades(v):
    """Each region, the first two, and the others."""
    one = v.region.select(F.col("r_regionkey").alias("clade"), F.col("r_name").alias("species"))
    return one.unionByName(one.withColumn("clade", F.when(F.col("clade") < 2, 5).otherwise(6).cast("long")))


F11_COPIES = "n AS MATERIALIZED (SELECT * FROM v_deep), tip AS (SELECT sample_id, tree_id, lo AS leaf, label, parent_lo, count(*) OVER (PARTITION BY tree_id, label) AS c FROM n WHERE is_leaf), z AS MATERIALIZED (SELECT u.tree_id, u.lo, u.hi, count(*) AS size FROM n u JOIN tip t ON t.tree_id = u.tree_id AND t.leaf BETWEEN u.lo AND u.hi WHERE NOT u.is_leaf GROUP BY ALL), a AS (SELECT t.sample_id, t.tree_id, t.leaf, t.label, min(z.lo) AS lo FROM tip t JOIN z ON z.tree_id = t.tree_id AND t.leaf BETWEEN z.lo AND z.hi WHERE t.c > 1 AND (z.lo = t.parent_lo OR z.size <= 4) GROUP BY ALL), h AS MATERIALIZED (SELECT a.sample_id, a.tree_id, a.leaf, a.label AS species, x.label AS other, count(*) AS n FROM a JOIN z ON z.tree_id = a.tree_id AND z.lo = a.lo JOIN tip x ON x.tree_id = a.tree_id AND x.leaf BETWEEN z.lo AND z.hi AND x.leaf <> a.leaf GROUP BY ALL)"


@query("f11_copy_neighbourhoods", f"WITH {F11_COPIES} SELECT tree_id, leaf, species, other, n FROM h")
def _(v):
    return Y.copy_neighbourhoods(v.v_deep, 4)


@query("f11_cluster_support", f"WITH {F11_COPIES}, w AS (SELECT sample_id, tree_id, leaf, species, sum(n) AS size FROM h GROUP BY ALL), f AS MATERIALIZED (SELECT h.sample_id, h.tree_id, h.leaf, h.species, k.clade, sum(h.n) / max(w.size) AS share FROM h JOIN {WIDE} k ON k.species = h.other JOIN w ON w.tree_id = h.tree_id AND w.leaf = h.leaf GROUP BY ALL), g AS (SELECT w.tree_id, w.leaf, k.clade FROM w JOIN {WIDE} k ON k.species = w.species LEFT JOIN f ON f.tree_id = w.tree_id AND f.leaf = w.leaf AND f.clade = k.clade WHERE coalesce(f.share, 0) < 0.5), t AS (SELECT sample_id, count(DISTINCT tree_id) AS trees FROM n GROUP BY sample_id) SELECT f.sample_id, g.clade, f.clade AS other, {r('sum(f.share) / max(t.trees)', 'total')}, {r('max(f.share)', 'peak')} FROM g JOIN f ON f.tree_id = g.tree_id AND f.leaf = g.leaf JOIN t ON t.sample_id = f.sample_id GROUP BY f.sample_id, g.clade, f.clade")
def _(v):
    samples = v.v_leaves.select("tree_id", "sample_id").distinct()
    around = Y.copy_neighbourhoods(v.v_deep, 4).join(samples, "tree_id")
    return rounded(Y.copy_cluster_support(around, wide_clades(v), samples.groupBy("sample_id").agg(F.count("*").alias("trees"))))


LCA = "(SELECT max(u.lo) FROM n u WHERE NOT u.is_leaf AND u.tree_id = x.tree_id AND u.lo <= x.a AND u.hi >= x.b)"


@query("f13_topology_summaries", f"""WITH n AS MATERIALIZED (SELECT * FROM v_deep), c AS (SELECT * FROM {WIDE} k WHERE clade > 4),
k AS MATERIALIZED (SELECT n.sample_id, n.tree_id, c.clade, n.label, count(*) AS n, min(n.lo) AS a, max(n.lo) AS b FROM n JOIN c ON c.species = n.label WHERE n.is_leaf GROUP BY ALL),
x1 AS (SELECT sample_id, tree_id, clade, min(a) AS a, max(b) AS b, count(CASE WHEN n > 1 THEN 1 END) AS multi FROM k GROUP BY ALL HAVING count(CASE WHEN n > 1 THEN 1 END) > 1),
top AS (SELECT *, {LCA} AS lo FROM x1 x),
parted AS (SELECT t.sample_id, t.tree_id, t.clade, max(t.multi) AS multi, k.label, count(DISTINCT ch.lo) AS sides FROM top t JOIN k ON k.tree_id = t.tree_id AND k.clade = t.clade AND k.n > 1 JOIN n ch ON ch.tree_id = t.tree_id AND ch.parent_lo = t.lo JOIN n l ON l.tree_id = t.tree_id AND l.is_leaf AND l.label = k.label AND l.lo BETWEEN ch.lo AND ch.hi GROUP BY t.sample_id, t.tree_id, t.clade, k.label),
co AS (SELECT sample_id, clade, avg(share) AS colocation FROM (SELECT sample_id, tree_id, clade, count(CASE WHEN sides > 1 THEN 1 END) / max(multi) AS share FROM parted GROUP BY ALL) q GROUP BY ALL),
x2 AS (SELECT sample_id, tree_id, clade, count(*) AS kinds, min(a) AS a, max(a) AS b FROM k GROUP BY ALL HAVING count(*) > 1),
mono AS (SELECT sample_id, clade, avg(kinds / size) AS monophyly FROM (SELECT x.*, (SELECT count(*) FROM n l JOIN n u ON u.tree_id = l.tree_id WHERE l.is_leaf AND u.tree_id = x.tree_id AND u.lo = {LCA} AND l.lo BETWEEN u.lo AND u.hi) AS size FROM x2 x) q GROUP BY ALL),
dep AS (SELECT sample_id, clade, count(*) AS c, avg(depth) AS mean, stddev_samp(depth) AS std FROM (SELECT x.sample_id, x.clade, (SELECT max(u.depth) FROM n u WHERE u.tree_id = x.tree_id AND NOT u.is_leaf AND u.lo <= x.a AND u.hi >= x.b) AS depth FROM k x WHERE x.n > 1) q GROUP BY ALL)
SELECT e.sample_id, e.clade, {r('coalesce(colocation, 0)', 'colocation')}, {r('coalesce(monophyly, 0)', 'monophyly')}, {r('CASE WHEN c IS NULL THEN 0 WHEN c = 1 OR mean = 0 THEN 1 ELSE 1 - least(std / mean, 1) END', 'consistency')}
FROM (SELECT DISTINCT n.sample_id, c.clade FROM n, c) e LEFT JOIN co USING (sample_id, clade) LEFT JOIN mono USING (sample_id, clade) LEFT JOIN dep USING (sample_id, clade)""")
def _(v):
    return rounded(Y.topology_summaries(cut(v.v_deep, "nodes"), wide_clades(v)))


T18 = """WITH tn AS MATERIALIZED (SELECT * FROM v_deep), pn AS MATERIALIZED (SELECT * FROM v_deep_priced),
a AS (SELECT tree_id, label, count(*) AS n, min(lo) AS leaf FROM tn WHERE is_leaf GROUP BY ALL), b AS (SELECT tree_id, label, count(*) AS n FROM pn WHERE is_leaf GROUP BY ALL),
bones AS MATERIALIZED (SELECT * FROM (SELECT a.tree_id, a.label, a.leaf, count(*) OVER (PARTITION BY a.tree_id) AS k FROM a JOIN b ON b.tree_id = a.tree_id AND b.label = a.label WHERE a.n = 1 AND b.n = 1) q WHERE k >= 3),
tc AS MATERIALIZED (SELECT u.tree_id, u.lo, u.hi, min(o.leaf) AS f, max(o.leaf) AS l FROM tn u JOIN tn x ON x.tree_id = u.tree_id AND x.is_leaf AND x.lo BETWEEN u.lo AND u.hi JOIN bones o ON o.tree_id = x.tree_id AND o.label = x.label WHERE NOT u.is_leaf GROUP BY ALL),
pc AS MATERIALIZED (SELECT u.tree_id, u.lo, u.hi, min(o.leaf) AS f, max(o.leaf) AS l FROM pn u JOIN pn x ON x.tree_id = u.tree_id AND x.is_leaf AND x.lo BETWEEN u.lo AND u.hi JOIN bones o ON o.tree_id = x.tree_id AND o.label = x.label WHERE NOT u.is_leaf GROUP BY ALL),
j AS MATERIALIZED (SELECT DISTINCT tree_id, f, l FROM tc WHERE f < l UNION SELECT tree_id, leaf, leaf FROM bones),
ta AS (SELECT x.tree_id, x.label, x.lo AS leaf, arg_max(c.f, c.lo) AS f, arg_max(c.l, c.lo) AS l FROM tn x JOIN a ON a.tree_id = x.tree_id AND a.label = x.label AND a.n > 1 JOIN tc c ON c.tree_id = x.tree_id AND x.lo BETWEEN c.lo AND c.hi WHERE x.is_leaf GROUP BY x.tree_id, x.label, x.lo),
pa AS (SELECT x.tree_id, x.label, x.lo AS leaf, arg_max(c.f, c.lo) AS f, arg_max(c.l, c.lo) AS l FROM pn x JOIN a ON a.tree_id = x.tree_id AND a.label = x.label AND a.n > 1 JOIN pc c ON c.tree_id = x.tree_id AND x.lo BETWEEN c.lo AND c.hi WHERE x.is_leaf GROUP BY x.tree_id, x.label, x.lo),
st AS (SELECT tree_id, label, arg_min(f, leaf) AS f, arg_min(l, leaf) AS l FROM pa GROUP BY ALL),
pr AS (SELECT ta.tree_id, ta.label, ta.f, ta.l, st.f AS f0, st.l AS l0 FROM ta JOIN st ON st.tree_id = ta.tree_id AND st.label = ta.label),
d AS (SELECT tree_id, label, min((SELECT count(*) FROM j WHERE j.tree_id = p.tree_id AND j.f <= p.f AND j.l >= p.l) + (SELECT count(*) FROM j WHERE j.tree_id = p.tree_id AND j.f <= p.f0 AND j.l >= p.l0) - 2 * (SELECT count(*) FROM j WHERE j.tree_id = p.tree_id AND j.f <= least(p.f, p.f0) AND j.l >= greatest(p.l, p.l0))) AS distance FROM pr p GROUP BY ALL)
SELECT tree_id, label AS species, distance, CASE WHEN distance = 0 THEN 'correct' WHEN distance <= 2 THEN 'local' ELSE 'long_range' END AS kind FROM d"""


@query("t18_displacement", T18)
def _(v):
    return Y.displacement(v.v_deep, v.v_deep_priced)


L15_SIDE = "SELECT x.tree_id, x.label, x.lo AS leaf, list_distinct(list(o.label)) AS beside FROM {0} x JOIN {0} u ON u.tree_id = x.tree_id AND u.lo = x.parent_lo JOIN {0} o ON o.tree_id = x.tree_id AND o.is_leaf AND o.lo BETWEEN u.lo AND u.hi AND o.label <> x.label WHERE x.is_leaf GROUP BY ALL"


@query("l15_placement_accuracy", f"WITH tn AS MATERIALIZED (SELECT * FROM v_deep), pn AS MATERIALIZED (SELECT * FROM v_deep_priced), t AS ({L15_SIDE.format('tn')}), p AS ({L15_SIDE.format('pn')}), f AS (SELECT tree_id, label, min(lo) AS leaf FROM pn WHERE is_leaf GROUP BY ALL), m AS (SELECT tree_id, label FROM tn WHERE is_leaf GROUP BY ALL HAVING count(*) > 1) SELECT t.tree_id, t.label AS species, {r('max(len(list_intersect(t.beside, p.beside)) / len(list_distinct(list_concat(t.beside, p.beside))))', 'best')}, max(len(list_intersect(t.beside, p.beside)) / len(list_distinct(list_concat(t.beside, p.beside)))) >= 0.5 AS hit FROM t JOIN m ON m.tree_id = t.tree_id AND m.label = t.label JOIN f ON f.tree_id = t.tree_id AND f.label = t.label JOIN p ON p.tree_id = f.tree_id AND p.label = f.label AND p.leaf = f.leaf GROUP BY t.tree_id, t.label")
def _(v):
    return rounded(E.placement_accuracy(v.v_deep, v.v_deep_priced))


# labels: the true species tree has regions over nations, the inferred one groups of the same key modulo 5
TRUE = "(SELECT n_nationkey + 6 AS node, n_regionkey + 1 AS parent, n_name AS species FROM nation UNION ALL SELECT n_regionkey + 1, 0, n_name FROM nation UNION ALL SELECT 0, NULL, n_name FROM nation)"
INFERRED = "(SELECT n_nationkey + 6 AS clade, n_name AS species FROM nation UNION ALL SELECT n_nationkey % 5 + 1, n_name FROM nation UNION ALL SELECT 0, n_name FROM nation)"
PARTNERS = "(SELECT event_ix AS event, n_name AS species FROM v_truth_events JOIN nation ON n_nationkey = partner_key UNION SELECT event_ix, n_name FROM v_truth_events JOIN nation ON n_nationkey = (partner_key + 5) % 25)"
PARENTS = f"""t AS MATERIALIZED (SELECT clade_id AS event, species, count(*) OVER (PARTITION BY clade_id) AS nt FROM {TARGETS} q), tn AS (SELECT *, count(*) OVER (PARTITION BY node) AS nn FROM {TRUE} q), ic AS (SELECT *, count(*) OVER (PARTITION BY clade) AS nc FROM {INFERRED} q),
sc AS (SELECT t.event, ic.clade, max(nt) AS nt, max(nc) AS nc FROM t JOIN ic ON ic.species = t.species GROUP BY t.event, ic.clade HAVING count(*) = max(nt)),
hc AS (SELECT event, arg_min(clade, nc * 100 + clade) AS clade FROM sc WHERE nc > nt GROUP BY event),
home AS (SELECT hc.event, list_sort(list_distinct(list(ic.species))) AS home FROM hc JOIN ic ON ic.clade = hc.clade WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.event = hc.event AND t.species = ic.species) GROUP BY hc.event),
sn AS (SELECT t.event, tn.node, max(tn.parent) AS parent FROM t JOIN tn ON tn.species = t.species GROUP BY t.event, tn.node HAVING count(*) = max(nt) AND max(nn) = max(nt)),
sp AS (SELECT event, arg_max(parent, node) AS parent FROM sn WHERE parent IS NOT NULL GROUP BY event),
sib AS (SELECT sp.event, list_sort(list_distinct(list(tn.species))) AS sibling FROM sp JOIN tn ON tn.node = sp.parent WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.event = sp.event AND t.species = tn.species) GROUP BY sp.event),
par AS MATERIALIZED (SELECT t.event, count(*) AS size, coalesce(max(CASE WHEN sc.nc = sc.nt THEN 1 END), 0) = 1 AS monophyletic, any_value(home.home) AS home, any_value(sib.sibling) AS sibling FROM (SELECT DISTINCT event, species FROM t) t LEFT JOIN (SELECT event, max(nt) AS nt, max(CASE WHEN nc = nt THEN nc END) AS nc FROM sc GROUP BY event) sc ON sc.event = t.event LEFT JOIN home ON home.event = t.event LEFT JOIN sib ON sib.event = t.event GROUP BY t.event),
ev AS MATERIALIZED (SELECT event_ix AS event, event_ix % 3 AS config, event_type, p.partner FROM v_truth_events JOIN (SELECT event, list_sort(list(species)) AS partner FROM {PARTNERS} q GROUP BY event) p ON p.event = event_ix)"""


def _parents(v):
    n = v.nation
    name, key = F.col("n_name").alias("species"), F.col("n_nationkey")
    none = F.lit(None).cast("long")
    true = n.select((key + 6).alias("node"), (F.col("n_regionkey") + 1).alias("parent"), name).unionByName(n.select((F.col("n_regionkey") + 1).alias("node"), F.lit(0).cast("long").alias("parent"), name)).unionByName(n.select(F.lit(0).cast("long").alias("node"), none.alias("parent"), name))
    inferred = n.select((key + 6).alias("clade"), name).unionByName(n.select((key % 5 + 1).alias("clade"), name)).unionByName(n.select(F.lit(0).cast("long").alias("clade"), name))
    return E.event_parents(targets(v).withColumnRenamed("clade_id", "event"), true, inferred)


def _labelled(v):
    e = v.v_truth_events.select(F.col("event_ix").alias("event"), (F.col("event_ix") % 3).alias("config"), "event_type", F.explode(F.array("partner_key", (F.col("partner_key") + 5) % 25)).alias("n_nationkey"))
    return e.join(v.nation, "n_nationkey").groupBy("event", "config", "event_type").agg(F.sort_array(F.collect_set("n_name")).alias("partner"))


@query("l3_away_partners", f"WITH {PARENTS} SELECT ev.event, array_to_string(CASE WHEN moved THEN sibling ELSE partner END, ',') AS partner, moved FROM (SELECT ev.*, par.sibling, coalesce(event_type = 'allo' AND (size = 1 OR monophyletic) AND home IS NOT NULL AND sibling IS NOT NULL AND list_has_any(home, partner), FALSE) AS moved FROM ev LEFT JOIN par ON par.event = ev.event) ev")
def _(v):
    return E.away_partners(_labelled(v), _parents(v)).withColumn("partner", F.array_join("partner", ","))


@query("l7_label_audit", f"WITH {PARENTS}, q AS (SELECT ev.config, CASE WHEN size = 1 THEN 'single' ELSE 'clade' END AS form, monophyletic, sibling, list_has_any(home, partner) AS hp, coalesce(list_has_any(home, sibling), FALSE) AS hs FROM ev JOIN par ON par.event = ev.event WHERE event_type = 'allo' AND home IS NOT NULL) SELECT config, form, count(*) AS n, count(CASE WHEN monophyletic THEN 1 END) AS monophyletic, count(CASE WHEN hp THEN 1 END) AS home_is_partner, count(CASE WHEN NOT hp AND hs THEN 1 END) AS home_is_sibling, count(CASE WHEN NOT hp AND NOT hs THEN 1 END) AS neither, count(CASE WHEN sibling IS NULL THEN 1 END) AS no_sibling FROM q GROUP BY config, form")
def _(v):
    return E.label_audit(_labelled(v), _parents(v))


MODES = f"SELECT sample_id, species, arg_min(n, freq * -1000 + n) AS mode FROM ({FULL}) f GROUP BY sample_id, species"


@query("l5_label_guards", f"WITH o AS ({MODES}), p AS (SELECT DISTINCT sample_id, target AS species FROM v_truth_events), k AS (SELECT sample_id, count(*) AS kinds FROM o GROUP BY ALL), u AS (SELECT o.sample_id, count(*) AS c FROM o WHERE mode >= 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.sample_id = o.sample_id AND p.species = o.species) GROUP BY ALL), m AS (SELECT sample_id, CASE WHEN sample_id % 4 = 0 THEN 24 ELSE 25 END AS n_species FROM o GROUP BY ALL), e AS (SELECT sample_id, count(DISTINCT target) AS labels, 25 AS features FROM v_truth_events GROUP BY ALL) SELECT *, same_species AND unknown_polyploids = 0 AND same_edges AS ok FROM (SELECT m.sample_id, coalesce(kinds = n_species, TRUE) AS same_species, coalesce(c, 0) AS unknown_polyploids, coalesce(labels = features, TRUE) AS same_edges FROM m LEFT JOIN k ON k.sample_id = m.sample_id LEFT JOIN u ON u.sample_id = m.sample_id LEFT JOIN e ON e.sample_id = m.sample_id) q")
def _(v):
    observed = X.copy_features(X.copies_per_tree(leaves(v))).select("sample_id", "species", "mode")
    metadata = observed.select("sample_id").distinct().withColumn("n_species", F.when(F.col("sample_id") % 4 == 0, 24).otherwise(25))
    found = v.v_truth_events.groupBy("sample_id").agg(F.count_distinct("target").alias("labels")).withColumn("features", F.lit(25))
    return E.label_guards(observed, metadata, v.v_truth_events.select("sample_id", F.col("target").alias("species")).distinct(), found)


L8_EDGES = f"(SELECT s.sample_id, e.edge, max(CASE WHEN t.sample_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS positive, count(CASE WHEN d.n > 0 THEN 1 END) / count(*) AS duplicated, (e.edge + s.sample_id + 1) % 30 AS partner FROM (SELECT DISTINCT sample_id FROM v_leaves) s CROSS JOIN {EDGES} e LEFT JOIN (SELECT DISTINCT sample_id, n_nationkey + 5 AS edge FROM v_truth_events JOIN nation ON n_name = target WHERE event_ix % 4 = 0) t ON t.sample_id = s.sample_id AND t.edge = e.edge LEFT JOIN (SELECT sample_id, species, count(*) AS n FROM ({COPIES}) c WHERE n >= 2 GROUP BY ALL) d ON d.sample_id = s.sample_id AND d.species = e.species GROUP BY s.sample_id, e.edge)"


@query("l8_fragmented_clades", f"WITH m AS (SELECT edge, species, count(*) OVER (PARTITION BY edge) AS size FROM {EDGES} q), x AS MATERIALIZED (SELECT * FROM {L8_EDGES} q), b AS (SELECT a.edge, t.edge AS tip FROM m a JOIN m t ON t.species = a.species AND t.size = 1 WHERE a.size > 1), p AS (SELECT x.sample_id, x.edge, count(*) AS tips, count(i.tip) AS inward FROM x JOIN b ON b.edge = x.edge JOIN x y ON y.sample_id = x.sample_id AND y.edge = b.tip AND y.positive LEFT JOIN b i ON i.edge = x.edge AND i.tip = y.partner WHERE NOT x.positive AND x.duplicated >= 0.5 GROUP BY x.sample_id, x.edge HAVING count(*) > 1) SELECT s.sample_id, count(p.edge) AS signature, count(CASE WHEN p.inward >= 2 AND 2 * p.inward > p.tips THEN 1 END) AS inward FROM (SELECT DISTINCT sample_id FROM x) s LEFT JOIN p ON p.sample_id = s.sample_id GROUP BY s.sample_id")
def _(v):
    own = edges(v)
    doubled = X.copies_per_tree(leaves(v)).filter("n >= 2").select("sample_id", "species").distinct().withColumn("doubled", F.lit(1))
    positive = v.v_truth_events.filter("event_ix % 4 = 0").join(v.nation, F.col("n_name") == F.col("target")).select("sample_id", (F.col("n_nationkey") + 5).alias("edge"), F.lit(True).alias("positive")).distinct()
    grid = v.v_leaves.select("sample_id").distinct().join(own).join(doubled, ["sample_id", "species"], "left").groupBy("sample_id", "edge").agg((F.count("doubled") / F.count("*")).alias("duplicated"))
    rows = grid.join(positive, ["sample_id", "edge"], "left").withColumns({"positive": F.coalesce("positive", F.lit(False)), "partner": (F.col("edge") + F.col("sample_id") + 1) % 30})
    return E.fragmented_clades(rows, own)


ROOTS = "SELECT n.sample_id, n.tree_id, n.lo, count(*) AS n, list_sort(list_distinct(list(t.label))) AS side FROM v_deep n JOIN v_deep t ON t.tree_id = n.tree_id AND t.is_leaf AND t.lo BETWEEN n.lo AND n.hi WHERE n.depth = 1 GROUP BY n.sample_id, n.tree_id, n.lo"


@query("l13_root_recovery", f"WITH s AS (SELECT sample_id, side FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY n, side) AS k FROM ({ROOTS}) q) w WHERE k = 1), c AS (SELECT sample_id, side, count(*) AS trees FROM s GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY trees DESC, side) AS k FROM c) q WHERE k = 1) SELECT b.sample_id, array_to_string(b.side, ',') AS side, trees, b.side = t.side OR b.side = list_sort(list_filter(e.every, lambda x: NOT list_contains(t.side, x))) AS recovered FROM b JOIN (SELECT DISTINCT sample_id, [r_name] AS side FROM v_deep JOIN region ON r_regionkey = sample_id % 5) t ON t.sample_id = b.sample_id JOIN (SELECT sample_id, list_sort(list_distinct(list(label))) AS every FROM v_deep WHERE is_leaf GROUP BY ALL) e ON e.sample_id = b.sample_id")
def _(v):
    samples = v.v_deep.select("tree_id", "sample_id").distinct()
    truth = samples.select("sample_id").distinct().join(v.region, F.col("sample_id") % 5 == F.col("r_regionkey")).select("sample_id", F.array("r_name").alias("side"))
    species = v.v_deep.filter("is_leaf").select("sample_id", F.col("label").alias("species"))
    return E.root_recovery(T.basal_splits(v.v_deep).join(samples, "tree_id"), truth, species).withColumn("side", F.array_join("side", ","))


F15 = f"""WITH c AS (SELECT sample_id, species, [sum(n * freq) / sum(freq), sum(n * n * freq) / sum(freq) - (sum(n * freq) / sum(freq)) * (sum(n * freq) / sum(freq)), arg_min(n, freq * -1000 + n), sum(CASE WHEN n = 0 THEN freq ELSE 0 END) / sum(freq), sum(CASE WHEN n = 1 THEN freq ELSE 0 END) / sum(freq), sum(CASE WHEN n = 2 THEN freq ELSE 0 END) / sum(freq), sum(CASE WHEN n >= 3 THEN freq ELSE 0 END) / sum(freq), max(n)] AS a FROM ({FULL}) f GROUP BY sample_id, species),
sp AS (SELECT DISTINCT sample_id, species FROM v_leaves), g AS (SELECT a.sample_id, a.species, coalesce(m.share, 0) AS s FROM sp a JOIN sp b ON a.sample_id = b.sample_id AND a.species <> b.species LEFT JOIN ({MATRIX}) m ON m.sample_id = a.sample_id AND m.species = a.species AND m.partner = b.species),
p AS (SELECT sample_id, species, [avg(s), stddev_pop(s), max(s), min(s), quantile_cont(s, 0.5)] AS b FROM g GROUP BY sample_id, species),
l AS MATERIALIZED (SELECT c.sample_id, c.species, n_regionkey, n_nationkey, list_concat(a, b) AS x FROM c JOIN p ON p.sample_id = c.sample_id AND p.species = c.species JOIN nation ON n_name = c.species),
u AS (SELECT sample_id, n_regionkey, i, avg(x[i]) AS y FROM l, range(1, 14) t(i) GROUP BY sample_id, n_regionkey, i),
v AS (SELECT l.sample_id, l.n_nationkey + 5 AS edge, u.i - 1 AS position, u.y AS value FROM l JOIN u ON u.sample_id = l.sample_id AND u.n_regionkey = l.n_regionkey UNION ALL SELECT sample_id, n_nationkey + 5, i + 12, x[i] FROM l, range(1, 14) t(i) UNION ALL SELECT sample_id, n_nationkey + 5, 26, n_nationkey / 10 FROM l UNION ALL SELECT sample_id, n_nationkey + 5, 27, n_regionkey FROM l)
SELECT sample_id, edge, position, {r('value', 'value')} FROM v"""


@query("f15_edge_vectors", F15)
def _(v):
    """Edges from regions to nations; a region has the mean of its nations."""
    own = leaves(v)
    found = X.copy_features(X.copies_per_tree(own)).join(X.profile_summary(X.sister_counts(own), own.select("sample_id", "species").distinct(), whole=False).toDF("sample_id", "species", "s1", "s2", "s3", "s4", "s5"), ["sample_id", "species"])
    columns = [c for c in found.columns if c not in ("sample_id", "species")]
    nations = found.join(v.nation, F.col("species") == F.col("n_name"))
    child = nations.select("sample_id", (F.col("n_nationkey") + 5).alias("node"), F.array(*(F.col(c).cast("double") for c in columns)).alias("features"))
    parent = nations.groupBy("sample_id", F.col("n_regionkey").alias("node")).agg(*(F.avg(c).alias(c) for c in columns)).select("sample_id", "node", F.array(*columns).alias("features"))
    links = nations.select("sample_id", (F.col("n_nationkey") + 5).alias("edge"), F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") + 5).alias("child"), F.array(F.col("n_nationkey") / 10, F.col("n_regionkey").cast("double")).alias("features"))
    vectors = X.edge_vectors(links, child.unionByName(parent))
    return rounded(vectors.select("sample_id", "edge", F.posexplode("vector").alias("position", "value")))
