"""Label, model, sequence, name and retention queries (L, M, Q, P and the rest of R) over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as P
from ..operators import labels as L
from ..operators import sequences as Q
from ..operators import summaries as S
from ..registry import query
from ..sources import readers as R
from .summary_queries import r, rounded
from .tree_queries import clades

EDGES = "(SELECT n_nationkey + 5 AS edge, n_name AS species FROM nation UNION ALL SELECT r_regionkey AS edge, n_name AS species FROM region JOIN nation ON n_regionkey = r_regionkey)"
TARGETS = "(SELECT event_ix AS clade_id, target AS species FROM v_truth_events WHERE NOT whole_clade UNION ALL SELECT event_ix, n_name FROM v_truth_events e JOIN region ON r_name = e.target_clade JOIN nation ON n_regionkey = r_regionkey WHERE whole_clade AND n_nationkey % 5 <> event_ix % 5)"


def edges(v):
    """Species-tree edges over the views: one per region, then one per nation."""
    return v.region.join(v.nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("edge"), F.col("n_name").alias("species")).unionByName(v.nation.select((F.col("n_nationkey") + 5).alias("edge"), F.col("n_name").alias("species")))


def targets(v):
    """Species of each event: its nation, or its region without the nations of one remainder, so that matches are partial."""
    one = v.v_truth_events.filter("not whole_clade").select(F.col("event_ix").alias("clade_id"), F.col("target").alias("species"))
    places = v.region.join(v.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    many = v.v_truth_events.filter("whole_clade").join(F.broadcast(places), F.col("target_clade") == F.col("r_name")).filter("n_nationkey % 5 <> event_ix % 5").select(F.col("event_ix").alias("clade_id"), F.col("n_name").alias("species"))
    return one.unionByName(many)


L2 = f"SELECT clade_id, edge, jaccard, jaccard >= 0.5 AS mappable FROM (SELECT *, row_number() OVER (PARTITION BY clade_id ORDER BY jaccard DESC, edge) AS k FROM (SELECT t.clade_id, e.edge, count(*) / (max(t.na) + max(e.nb) - count(*)) AS jaccard FROM (SELECT *, count(*) OVER (PARTITION BY clade_id) AS na FROM {TARGETS} x) t JOIN (SELECT *, count(*) OVER (PARTITION BY edge) AS nb FROM {EDGES} y) e ON t.species = e.species GROUP BY t.clade_id, e.edge) s) q WHERE k = 1"


@query("l1_event_problems", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_ix % 17 = 0 THEN 'unknown type' WHEN event_ix % 13 = 0 THEN 'empty target' WHEN event_type = 'allo' AND partner_key = 0 THEN 'no partner' END AS problem FROM v_truth_events) q GROUP BY problem")
def _(v):
    e = v.v_truth_events.select(F.when(F.col("event_ix") % 17 == 0, "odd").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_ix") % 13 != 0, F.array("target")).alias("target_clade"), F.when(F.col("partner_key") != 0, F.array(F.col("partner_key").cast("string"))).otherwise(F.array().cast("array<string>")).alias("partner_clade"))
    return L.event_problems(e).groupBy("problem").agg(F.count("*").alias("n"))


@query("l2_map_to_edges", f"SELECT clade_id, edge, {r('jaccard', 'jaccard')}, mappable FROM ({L2}) q")
def _(v):
    return rounded(L.map_to_edges(targets(v), edges(v)))


@query("l4_home_edges", f"SELECT clade_id, arg_min(edge, nb * 100 + edge) AS home FROM (SELECT t.clade_id, e.edge, max(e.nb) AS nb, max(t.na) AS na, count(*) AS k FROM (SELECT *, count(*) OVER (PARTITION BY clade_id) AS na FROM {TARGETS} x) t JOIN (SELECT *, count(*) OVER (PARTITION BY edge) AS nb FROM {EDGES} y) e ON t.species = e.species GROUP BY t.clade_id, e.edge) s WHERE k = na AND nb > na GROUP BY clade_id")
def _(v):
    return L.home_edges(targets(v), edges(v))


@query("l6_event_composition", "SELECT sample_id, event_type, size, n, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM (SELECT sample_id, event_type, CASE WHEN whole_clade THEN 5 ELSE 1 END AS size, count(*) AS n FROM v_truth_events GROUP BY ALL) q")
def _(v):
    return rounded(L.event_composition(v.v_truth_events.withColumn("size", F.when(F.col("whole_clade"), 5).otherwise(1))))


@query("l9_dropped_rate", f"SELECT event_ix % 3 AS config, count(*) AS events, count(CASE WHEN NOT mappable THEN 1 END) AS dropped, {r('avg(CASE WHEN mappable THEN 0.0 ELSE 1.0 END)', 'rate')} FROM v_truth_events JOIN ({L2}) m ON m.clade_id = event_ix GROUP BY 1")
def _(v):
    mapped = L.map_to_edges(targets(v), edges(v))
    return rounded(L.dropped_rate(v.v_truth_events.join(mapped, F.col("event_ix") == F.col("clade_id")).withColumn("config", F.col("event_ix") % 3)))


@query("l10_binned_sizes", "SELECT bin, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN c <= 2 THEN '<= 2' WHEN c <= 4 THEN '<= 4' WHEN c <= 8 THEN '<= 8' ELSE '> 8' END AS bin, count(*) AS n FROM (SELECT tree_id, count(*) AS c FROM v_leaves GROUP BY tree_id) t GROUP BY 1) q")
def _(v):
    return rounded(L.binned_sizes(v.v_leaves.groupBy("tree_id").agg(F.count("*").alias("size")), (2, 4, 8)))


@query("l11_class_statistics", f"SELECT label, feature, count(*) AS n, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('median(x)', 'median')} FROM (SELECT target AS label, 'prob' AS feature, CAST(prob AS DOUBLE) AS x FROM v_edge_scores UNION ALL SELECT target, 'edge_ix', CAST(edge_ix AS DOUBLE) FROM v_edge_scores) q GROUP BY label, feature")
def _(v):
    return rounded(L.class_statistics(v.v_edge_scores, "target", ["prob", "edge_ix"]))


@query("l17_compare_labels", f"WITH m AS ({L2}), b AS (SELECT sample_id, event_ix, event_type, edge, edge % 5 AS partner, mappable FROM v_truth_events JOIN m ON m.clade_id = event_ix), a AS (SELECT sample_id, event_ix, CASE WHEN event_ix % 7 = 0 THEN 0 ELSE edge END AS edge, event_ix % 5 AS partner FROM b WHERE event_ix % 11 <> 0) SELECT b.sample_id, count(a.edge) AS both, count(CASE WHEN a.edge = b.edge THEN 1 END) AS same_edge, count(CASE WHEN event_type = 'allo' AND a.partner <> b.partner THEN 1 END) AS partner_changed, {r('avg(CASE WHEN mappable THEN 1.0 ELSE 0.0 END)', 'mappable')} FROM b LEFT JOIN a ON a.sample_id = b.sample_id AND a.event_ix = b.event_ix GROUP BY b.sample_id")
def _(v):
    new = v.v_truth_events.join(L.map_to_edges(targets(v), edges(v)), F.col("event_ix") == F.col("clade_id")).withColumn("partner", F.col("edge") % 5)
    old = new.filter("event_ix % 11 <> 0").withColumns({"edge": F.when(F.col("event_ix") % 7 == 0, 0).otherwise(F.col("edge")), "partner": F.col("event_ix") % 5})
    return rounded(L.compare_labels(old, new))


GRID = [round(0.05 + 0.025 * i, 3) for i in range(38)]
SWEEP = f"SELECT threshold, count(CASE WHEN prob >= threshold AND target = 1 THEN 1 END) AS tp, count(CASE WHEN prob >= threshold AND target <> 1 THEN 1 END) AS fp, count(CASE WHEN prob < threshold AND target = 1 THEN 1 END) AS fn FROM v_edge_scores CROSS JOIN (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {', '.join(f'({t})' for t in GRID)}) g(t)) h GROUP BY threshold"
SCORED = f"SELECT threshold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM ({SWEEP}) s"


@query("m3_threshold_sweep", f"SELECT threshold, tp, fp, fn, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')} FROM ({SCORED}) q")
def _(v):
    return rounded(L.threshold_sweep(v.v_edge_scores, GRID))


@query("m2_best_threshold", f"SELECT threshold, {r('f1', 'f1')} FROM ({SCORED}) q ORDER BY round(q.f1, 9) DESC, threshold LIMIT 1")
def _(v):
    return rounded(L.best_threshold(L.threshold_sweep(v.v_edge_scores, GRID)))


@query("m6_error_budget", f"SELECT config, {r('CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp) ELSE 0.0 END', 'precision')}, {r('CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn) ELSE 0.0 END', 'recall')}, {r('CASE WHEN sum(tp + fp + fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END', 'f1')}, {r('avg(abs(fp - fn))', 'count_error')} FROM (SELECT config, sample_id, count(CASE WHEN prob >= 0.3 AND target = 1 THEN 1 END) AS tp, count(CASE WHEN prob >= 0.3 AND target <> 1 THEN 1 END) AS fp, count(CASE WHEN prob < 0.3 AND target = 1 THEN 1 END) AS fn FROM v_edge_scores GROUP BY ALL) q GROUP BY config")
def _(v):
    return rounded(L.error_budget(v.v_edge_scores, 0.3))


@query("m5_false_positive_relations", "WITH e AS (SELECT sample_id, edge_ix AS edge, CAST(floor(edge_ix / 3.0) AS BIGINT) AS parent, prob >= 0.3 AS hit, target FROM v_edge_scores), f AS (SELECT * FROM e WHERE hit AND target = 0), k AS (SELECT f.sample_id, f.edge, min(CASE WHEN t.parent = f.edge THEN 0 WHEN f.parent = t.edge THEN 1 WHEN f.parent = t.parent THEN 2 ELSE 3 END) AS rk FROM f JOIN e t ON t.sample_id = f.sample_id AND t.target = 1 GROUP BY f.sample_id, f.edge) SELECT f.sample_id, f.edge, CASE rk WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'sibling' WHEN 3 THEN 'scattered' ELSE 'no true edge' END AS relation FROM f LEFT JOIN k ON k.sample_id = f.sample_id AND k.edge = f.edge")
def _(v):
    return L.false_positive_relations(v.v_edge_scores.select("sample_id", F.col("edge_ix").alias("edge"), F.floor(F.col("edge_ix") / 3).alias("parent"), (F.col("prob") >= 0.3).alias("hit"), "target"))


def candidates(v):
    """Edges of orders as samples: each pair of leaves is an edge, its species the clade, the quantity the score."""
    pairs = v.v_leaves.groupBy("tree_id", F.floor(F.col("pos") / 2).alias("edge_ix")).agg((F.sum("dist") / 100).alias("prob"), F.collect_set("species").alias("s"))
    return pairs.select(F.col("tree_id").alias("sample_id"), "edge_ix", "prob", F.explode("s").alias("species"), F.lit(2).alias("bound"))


@query("m8_detect_only", "SELECT tree_id AS sample_id, CAST(floor(pos / 2.0) AS BIGINT) AS edge_ix FROM v_leaves GROUP BY 1, 2 HAVING sum(dist) / 100 >= 0.5")
def _(v):
    return L.select_edges(candidates(v), "detect_only", 0.5)


#: Edges by falling score; a species may be in one taken edge, as the bound is two copies. ``ok`` says which edges may be taken.
SCAN = """WITH RECURSIVE e AS (SELECT tree_id, CAST(floor(pos / 2.0) AS BIGINT) AS edge_ix, sum(dist) / 100 AS prob, list_distinct(list(species)) AS s FROM v_leaves GROUP BY 1, 2),
o AS (SELECT tree_id, list(edge_ix ORDER BY prob DESC, edge_ix) AS edges, list(s ORDER BY prob DESC, edge_ix) AS sets, list(prob >= 0.5 ORDER BY prob DESC, edge_ix) AS sure FROM e GROUP BY tree_id),
g AS (SELECT *, 0 AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS taken FROM o UNION ALL SELECT tree_id, edges, sets, sure, i + 1, CASE WHEN list_has_any(used, sets[i + 1]) OR NOT (OK) THEN used ELSE list_concat(used, sets[i + 1]) END, CASE WHEN list_has_any(used, sets[i + 1]) OR NOT (OK) THEN taken ELSE list_append(taken, edges[i + 1]) END FROM g WHERE i < len(edges))
SELECT e.tree_id AS sample_id, e.edge_ix FROM e JOIN g ON g.tree_id = e.tree_id AND g.i = len(g.edges) WHERE list_contains(g.taken, e.edge_ix) MORE"""
STRATEGIES = {"cap": SCAN.replace("OK", "sure[i + 1]").replace("MORE", ""), "bound_driven": SCAN.replace("OK", "TRUE").replace("MORE", ""), "detect": SCAN.replace("OK", "TRUE").replace("MORE", "OR e.prob >= 0.5")}

for _strategy in STRATEGIES:

    @query(f"m8_{_strategy}", STRATEGIES[_strategy])
    def _(v, strategy=_strategy):
        return L.select_edges(candidates(v), strategy, 0.5)


def embedded(v):
    return v.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 0).cast("int").alias("label"))


@query("m1_edge_classifiers")
def _(v):
    return L.edge_classifiers(embedded(v))


@query("m1_feature_importances")
def _(v):
    return L.feature_importances(embedded(v))


@query("m4_permutation_importance")
def _(v):
    return L.permutation_importance(embedded(v))


LINES = "SELECT lang AS dataset, doc_id AS gene, length(text) AS length, length(text) - length(replace(text, chr(10), '')) + 1 AS sequences, (length(text) - length(replace(replace(text, ' ', ''), '-', ''))) / greatest(length(text), 1) AS gaps FROM documents"


def alignments(v):
    t = F.col("text")
    return v.documents.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("gene"), F.length(t).alias("length"), (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).alias("sequences"), ((F.length(t) - F.length(F.translate(t, " -", ""))) / F.greatest(F.length(t), F.lit(1))).alias("gaps"))


@query("q1_describe_lengths", f"SELECT CASE WHEN grouping(dataset) = 1 THEN 'Combined' ELSE dataset END AS dataset, count(*) AS n, min(length) AS min, max(length) AS max, {r('avg(length)', 'mean')}, {r('quantile_cont(length, 0.5)', 'median')}, {r('stddev_pop(length)', 'std')}, {r('quantile_cont(length, 0.25)', 'q1')}, {r('quantile_cont(length, 0.75)', 'q3')} FROM ({LINES}) a GROUP BY GROUPING SETS ((dataset), ())")
def _(v):
    return rounded(Q.describe(alignments(v), "length"))


@query("q2_substitution_rates", f"SELECT a.dataset, gene, round(length / (my * 1000000.0 / years) * 1000, 9) AS rate FROM ({LINES}) a JOIN (SELECT lang AS dataset, count(*) AS my, 5.0 AS years FROM documents GROUP BY lang) s ON a.dataset = s.dataset")
def _(v):
    species = v.documents.groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("height_my")).withColumn("generation_years", F.lit(5.0))
    return Q.substitution_rates(alignments(v).withColumn("height", F.col("length")), species).withColumn("rate", F.round(F.col("rate") * 1000, 9))


@query("q3_pass_rate", f"SELECT dataset, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS passed, {r('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)', 'rate')} FROM (SELECT dataset, length >= 500 AND sequences >= 3 AND gaps <= 0.2 AS ok FROM ({LINES}) a) q GROUP BY dataset")
def _(v):
    return rounded(Q.pass_rate(Q.quality_check(alignments(v), 500, 3, 0.2)))


@query("q3_quality_reasons", f"SELECT gene, concat_ws(',', CASE WHEN length < 500 THEN 'short' END, CASE WHEN sequences < 3 THEN 'few sequences' END, CASE WHEN gaps > 0.2 THEN 'gaps' END) AS reasons FROM ({LINES}) a")
def _(v):
    return Q.quality_check(alignments(v), 500, 3, 0.2).select("gene", F.array_join("reasons", ",").alias("reasons"))


@query("q4_outliers", f"SELECT dataset, count(*) AS n, count(CASE WHEN sequences > 8 THEN 1 END) AS outliers, {r('avg(CASE WHEN sequences > 8 THEN 1.0 ELSE 0.0 END)', 'share')}, {r('avg(CASE WHEN sequences > 8 THEN sequences END)', 'mean_over')}, {r('avg(CASE WHEN sequences <= 8 THEN sequences END)', 'mean_rest')} FROM ({LINES}) a GROUP BY dataset")
def _(v):
    return rounded(Q.outliers(alignments(v), "sequences", 8))


@query("s5_fasta_records", "SELECT doc_id, CAST(length(text) AS BIGINT) AS residues FROM (SELECT doc_id, regexp_replace(replace(text, '>', ''), '\\s', '', 'g') AS text FROM documents) d")
def _(v):
    files = v.documents.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit(">s1 some words\n"), F.translate("text", ">", "")).alias("value"))
    return R.parse_fasta(files).select(F.col("path").cast("long").alias("doc_id"), F.length("sequence").cast("long").alias("residues"))


REPORT = "SELECT o_orderkey AS k, o_custkey % 97 AS dup, o_custkey % 31 AS loss, CAST(floor(o_totalprice) AS BIGINT) AS seconds, o_orderstatus AS s FROM orders"


def reports(v):
    o = v.orders
    dup, loss = F.col("o_custkey") % 97, F.col("o_custkey") % 31
    text = F.concat_ws("\n", F.concat(F.lit("duplications: "), dup), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("Losses: "), loss)), F.concat(F.lit("Duration: "), F.floor("o_totalprice"), F.lit(" seconds")), F.when(F.col("o_orderstatus") != "P", F.lit("COMPLETED SUCCESSFULLY")))
    return o.select(F.col("o_orderkey").cast("string").alias("path"), text.alias("value"))


@query("s7_reconciliation_counts", f"SELECT k AS path, CAST(dup AS INT) AS duplications, CAST(loss AS INT) AS losses FROM ({REPORT}) q WHERE k % 9 <> 0")
def _(v):
    return R.parse_reconciliation(reports(v)).withColumn("path", F.col("path").cast("long"))


@query("s8_durations", f"SELECT k AS path, CAST(seconds AS DOUBLE) AS seconds FROM ({REPORT}) q WHERE s <> 'P' AND seconds > 0")
def _(v):
    return R.parse_durations(reports(v)).withColumn("path", F.col("path").cast("long"))


@query("s9_json_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(v):
    return v.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("r35_duplication_averages", f"SELECT network, count(*) AS n, {r('avg(dup)', 'mean_dup')}, min(dup) AS min_dup, max(dup) AS max_dup, {r('median(dup)', 'median_dup')}, {r('avg(loss)', 'mean_loss')} FROM (SELECT k % 21 AS network, dup, loss FROM ({REPORT}) q WHERE k % 9 <> 0) w GROUP BY network")
def _(v):
    rows = R.parse_reconciliation(reports(v)).withColumn("network", F.col("path").cast("long") % 21)
    return rounded(rows.groupBy("network").agg(F.count("*").alias("n"), F.avg("duplications").alias("mean_dup"), F.min("duplications").cast("long").alias("min_dup"), F.max("duplications").cast("long").alias("max_dup"), F.median("duplications").alias("median_dup"), F.avg("losses").alias("mean_loss")))


@query("r37_average_distance", f"SELECT count(*) AS networks, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'std')}, {r('max(m) - min(m)', 'range')} FROM (SELECT network, avg(value) AS m FROM v_comparisons WHERE status = 'SUCCESS' AND metric = 0 GROUP BY network) q")
def _(v):
    per = v.v_comparisons.filter(S.SUCCESS).filter("metric = 0").groupBy("network").agg(F.avg("value").alias("m"))
    return rounded(per.agg(F.count("*").alias("networks"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), (F.max("m") - F.min("m")).alias("range")))


@query("r33_retention", "SELECT CASE WHEN grouping(tree) = 1 THEN NULL ELSE tree END AS network, count(CASE WHEN i > 1 THEN 1 END) AS kept, count(CASE WHEN i <= 1 THEN 1 END) AS lost, count(CASE WHEN i <> t THEN 1 END) AS changed, round(count(CASE WHEN i > 1 THEN 1 END) / count(*), 6) AS fraction FROM (SELECT a.tree_id % 21 AS tree, a.n AS t, b.n AS i FROM v_truth_copies a JOIN v_inferred_copies b ON a.tree_id = b.tree_id AND a.species = b.species WHERE a.n > 1) q GROUP BY ROLLUP (tree)")
def _(v):
    both = v.v_truth_copies.filter("n > 1").select("tree_id", "species", F.col("n").alias("t")).join(v.v_inferred_copies.withColumnRenamed("n", "i"), ["tree_id", "species"]).withColumn("network", F.col("tree_id") % 21)
    n = lambda c: F.count(F.when(c, 1))
    return rounded(both.rollup("network").agg(n(F.col("i") > 1).alias("kept"), n(F.col("i") <= 1).alias("lost"), n(F.col("i") != F.col("t")).alias("changed"), (n(F.col("i") > 1) / F.count("*")).alias("fraction")))


LABEL = "concat(species, '_', clade)"


@query("p1_species_modes", f"SELECT DISTINCT {LABEL} AS label, split_part({LABEL}, '_', 1) AS before, substr({LABEL}, position('_' IN {LABEL}) + 1) AS after FROM v_leaves")
def _(v):
    label = v.v_leaves.select(F.concat_ws("_", "species", "clade").alias("label")).distinct()
    return label.select("label", P.species_of("label", "before").alias("before"), P.species_of("label", "after").alias("after"))


@query("p2_strip_taxa", "SELECT tree_id, regexp_replace(newick, '_[^(),:;]*', '', 'g') AS newick FROM v_newick")
def _(v):
    return v.v_newick.select("tree_id", P.strip_after_underscore("newick").alias("newick"))


@query("p4_strip_internal", "SELECT tree_id, regexp_replace(newick, '\\)[^(),:;]+', ')', 'g') AS newick, TRUE AS balanced FROM v_newick")
def _(v):
    marked = v.v_newick.select("tree_id", F.regexp_replace("newick", r"\):", ")95*:").alias("newick"))
    return marked.select("tree_id", P.strip_internal_labels("newick").alias("newick"), P.balanced("newick").alias("balanced"))


@query("p6_substring_taxa", "SELECT a.n_name AS taxon, string_agg(b.n_name, ',' ORDER BY b.n_name) AS longer FROM nation a JOIN nation b ON contains(b.n_name, a.n_name) AND a.n_name <> b.n_name GROUP BY a.n_name")
def _(v):
    return P.substring_taxa(v.nation.select(F.col("n_name").alias("taxon"))).select("taxon", F.array_join("longer", ",").alias("longer"))


@query("p7_safe_names", "SELECT DISTINCT a.n_name AS taxon, concat(a.n_name, 'X') AS name FROM nation a JOIN nation b ON contains(b.n_name, a.n_name) AND a.n_name <> b.n_name")
def _(v):
    taxa = v.nation.select(F.col("n_name").alias("taxon"))
    return P.safe_names(P.substring_taxa(taxa).select("taxon"), taxa)


NUMBERED = "SELECT tree_id, pos, species, row_number() OVER (PARTITION BY tree_id, species ORDER BY pos) AS k FROM v_leaves"


@query("p8_number_copies", f"SELECT tree_id, pos, concat(k, '_', species) AS prefixed, concat(species, '_', k) AS suffixed FROM ({NUMBERED}) q")
def _(v):
    return P.number_copies(v.v_leaves).select("tree_id", "pos", "prefixed", "suffixed")


@query("p9_taxon_map", f"SELECT species, string_agg(concat(species, '_', k), ',' ORDER BY k) AS names FROM (SELECT DISTINCT species, k FROM ({NUMBERED}) q) w GROUP BY species")
def _(v):
    copies = v.v_leaves.groupBy("tree_id", "species").agg(F.count("*").alias("n"))
    return P.taxon_map(copies).select("species", F.array_join("names", ",").alias("names"))


@query("p11_keep_listed", "SELECT tree_id, pos, species FROM v_leaves WHERE species IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def _(v):
    return v.v_leaves.join(F.broadcast(v.nation.filter("n_regionkey = 1").select(F.col("n_name").alias("species"))), "species", "left_semi").select("tree_id", "pos", "species")


@query("p12_validate_trees", "SELECT tree_id, CASE WHEN n < 2 THEN 'few tips' WHEN unknown > 0 THEN 'unknown species' WHEN greatest(CAST(floor((n + 1) / 2.0) AS BIGINT), 2) > 2 THEN 'polytomy' WHEN CAST(floor((n + 1) / 2.0) AS BIGINT) <> 2 THEN 'unrooted' ELSE 'ok' END AS verdict, 0 AS zero_branches FROM (SELECT tree_id, count(*) AS n, count(CASE WHEN species = 'NATION_3' THEN 1 END) AS unknown FROM v_leaves GROUP BY tree_id) q")
def _(v):
    return P.validate_trees(v.v_nodes, v.nation.filter("n_name <> 'NATION_3'").select(F.col("n_name").alias("species")))


@query("p13_tag_levels", "SELECT network, CASE WHEN config = 0 THEN 'low' WHEN config = 1 THEN 'high' ELSE 'Unknown' END AS level, count(*) AS n FROM v_comparisons GROUP BY ALL")
def _(v):
    from .summary_queries import levels

    return v.v_comparisons.join(F.broadcast(levels(v)), "config", "left").groupBy("network", F.coalesce("level", F.lit("Unknown")).alias("level")).agg(F.count("*").alias("n"))


@query("p14_sample_trees", "SELECT sample_id, tree_id FROM (SELECT sample_id, tree_id, row_number() OVER (PARTITION BY sample_id ORDER BY sha256(concat('7|', tree_id)), tree_id) AS k FROM v_newick) q WHERE k <= 50")
def _(v):
    return P.sample_trees(v.v_newick.select("sample_id", "tree_id"), 50, "7")


@query("p15_flatten_metrics", f"SELECT network, method, metric, name, {r('value', 'value')} FROM (SELECT network, method, metric, 'mean' AS name, avg(value) AS value FROM v_comparisons GROUP BY ALL UNION ALL SELECT network, method, metric, 'max', max(value) FROM v_comparisons GROUP BY ALL) q")
def _(v):
    nested = v.v_comparisons.groupBy("network", "method", "metric").agg(F.struct(F.avg("value").alias("mean"), F.max("value").alias("max")).alias("m"))
    return rounded(nested.select("network", "method", "metric", "m.*").unpivot(["network", "method", "metric"], ["mean", "max"], "name", "value"))


@query("p17_gene_species", "SELECT concat(n_name, '_', r_name, '_g') AS gene, arg_max(s.species, length(s.species)) AS species FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT n_name AS species FROM nation UNION ALL SELECT 'NATION') s ON starts_with(concat(n_name, '_', r_name, '_g'), concat(s.species, '_')) GROUP BY 1")
def _(v):
    genes = clades(v).select(F.concat_ws("_", "species", "clade", F.lit("g")).alias("gene"))
    species = v.nation.select(F.col("n_name").alias("species")).union(v.spark.createDataFrame([("NATION",)], "species string"))
    return P.gene_species(genes, species)



@query("c8_changed_pairs", "SELECT o_orderkey AS key, sha256(o_orderstatus) AS truth_hash, sha256(o_orderpriority) AS inferred_hash FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 9 = 0")
def _(v):
    from ..operators import inventory as I

    pairs = v.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("truth"), F.col("o_orderpriority").alias("inferred"))
    stored = pairs.filter("key % 4 <> 0").select("key", F.sha2("truth", 256).alias("truth_hash"), F.sha2(F.when(F.col("key") % 9 == 0, "old").otherwise(F.col("inferred")), 256).alias("inferred_hash"))
    return I.changed_pairs(pairs, stored)


METHODS = ("click", "error", "purchase", "signup", "view")


@query("r36_conditions_table", f"WITH w AS (SELECT CAST(network AS VARCHAR) AS network, {', '.join(f'''avg(CASE WHEN method = '{m}' THEN value END) AS {m}''' for m in METHODS)} FROM v_comparisons GROUP BY network), u AS (SELECT * FROM w UNION ALL SELECT 'MEAN', {', '.join(f'avg({m})' for m in METHODS)} FROM w UNION ALL SELECT 'STD', {', '.join(f'stddev_samp({m})' for m in METHODS)} FROM w) SELECT network, {', '.join(r(m, m) for m in METHODS)} FROM u")
def _(v):
    return rounded(S.conditions_table(v.v_comparisons.select("network", F.col("method").alias("condition"), "value"), METHODS))


DOUBLED = "SELECT tree_id % 21 AS network, tree_id % 5 AS replicate, species, n FROM v_truth_copies WHERE n > 1"


@query("r34_retention_study", f"WITH c AS (SELECT network, replicate, species, n, count(*) AS genes FROM ({DOUBLED}) d GROUP BY ALL), m AS (SELECT network, count(*) AS eligible, count(CASE WHEN n = 2 THEN 1 END) AS reduced FROM ({DOUBLED}) d GROUP BY ROLLUP (network)) SELECT p.*, {r('1 - reduced / eligible', 'retention')} FROM (SELECT network, count(DISTINCT replicate) AS replicates, count(DISTINCT species) AS polyploids, {r('sum(n * genes) / sum(genes)', 'mean_copies')}, {r('sum(CASE WHEN n = 1 THEN genes ELSE 0 END) / sum(genes)', 'single')} FROM c GROUP BY ROLLUP (network)) p JOIN m ON p.network IS NOT DISTINCT FROM m.network")
def _(v):
    rows = v.v_truth_copies.filter("n > 1").select((F.col("tree_id") % 21).alias("network"), (F.col("tree_id") % 5).alias("replicate"), "species", "n")
    copies = rows.groupBy("network", "replicate", "species", "n").agg(F.count("*").alias("genes"))
    removal = rows.groupBy("network", "replicate").agg(F.count("*").alias("eligible"), F.count(F.when(F.col("n") == 2, 1)).alias("reduced"))
    return rounded(S.retention_study(copies, removal))


@query("f14_propagate", "SELECT tree_id, lo, round(avg(n_nationkey), 6) AS value FROM (SELECT DISTINCT n.tree_id, n.lo, l.label AS species FROM v_nodes n JOIN v_nodes l ON n.tree_id = l.tree_id AND l.is_leaf AND l.lo BETWEEN n.lo AND n.hi WHERE NOT n.is_leaf) m JOIN nation ON n_name = species GROUP BY tree_id, lo")
def _(v):
    from ..operators import features as X
    from ..operators import trees as T

    return rounded(X.propagate(T.clade_members(v.v_nodes), v.nation.select(F.col("n_name").alias("species"), F.col("n_nationkey").cast("double").alias("value"))))


PARTNERS = "SELECT sample_id, a.n_name AS species, b.n_name AS partner FROM (SELECT DISTINCT sample_id, species FROM v_leaves) l JOIN nation a ON a.n_name = l.species JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25"


@query("l12_partner_ranks", f"WITH m AS (SELECT sample_id, species, partner, count(*) / max(trees) AS share FROM (SELECT DISTINCT a.sample_id, a.tree_id, a.species, b.species AS partner FROM v_leaves a JOIN v_leaves b ON a.tree_id = b.tree_id AND CAST(floor(a.pos / 2.0) AS BIGINT) = CAST(floor(b.pos / 2.0) AS BIGINT) AND a.species <> b.species) s JOIN (SELECT sample_id, count(DISTINCT tree_id) AS trees FROM v_leaves GROUP BY sample_id) t USING (sample_id) GROUP BY sample_id, species, partner), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, species ORDER BY share DESC, partner) AS rk FROM m) SELECT p.sample_id, count(*) AS n, {', '.join(r(f'avg(CASE WHEN rk <= {i} THEN 1.0 ELSE 0.0 END)', f'top{i}') for i in (1, 2, 3))} FROM ({PARTNERS}) p LEFT JOIN k ON k.sample_id = p.sample_id AND k.species = p.species AND k.partner = p.partner GROUP BY p.sample_id")
def _(v):
    from ..operators import features as X
    from .tree_queries import leaves

    own = leaves(v)
    a = v.nation.select(F.col("n_name").alias("species"), ((F.col("n_nationkey") + 1) % 25).alias("key"))
    b = v.nation.select(F.col("n_name").alias("partner"), F.col("n_nationkey").alias("key"))
    truth = own.select("sample_id", "species").distinct().join(F.broadcast(a.join(b, "key").drop("key")), "species")
    return rounded(X.partner_ranks(X.coclustering(own), truth))


@query("l16_detection_by_outcome", f"SELECT CASE WHEN target = 0 THEN 'diploid' WHEN prob >= 0.3 THEN 'caught' ELSE 'missed' END AS outcome, count(*) AS n, {r('quantile_cont(prob, 0.25)', 'q1')}, {r('quantile_cont(prob, 0.5)', 'median')}, {r('quantile_cont(prob, 0.75)', 'q3')}, {r('avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END)', 'sure')} FROM (SELECT sample_id, edge_ix % 50 AS species, max(CAST(prob AS DOUBLE)) AS prob, max(target) AS target FROM v_edge_scores GROUP BY ALL) q GROUP BY 1")
def _(v):
    scores = v.v_edge_scores.select("sample_id", (F.col("edge_ix") % 50).alias("species"), F.col("prob").cast("double").alias("prob"), (F.col("target") == 1).alias("polyploid"), (F.col("prob") >= 0.3).alias("predicted"))
    return rounded(L.detection_by_outcome(scores))
