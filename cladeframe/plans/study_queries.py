"""Queries on whole studies: retention JSON, ranks with completion, matched runs, histograms, names and roots (second forms of S, R, L, M, Q, T, F and P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as P
from ..operators import features as X
from ..operators import labels as L
from ..operators import networks as N
from ..operators import sequences as Q
from ..operators import summaries as S
from ..operators import trees as T
from ..registry import query
from ..sources import readers as R
from .label_queries import LINES, METHODS, NUMBERED, alignments
from .rest_queries import S6, model_reports
from .summary_queries import OK, PAIRS, r, rounded
from .tree_queries import CLADES, CLUSTERS, PAIR, clades, clusters, flat

COPIES_OF = "c AS (SELECT tree_id % 21 AS network, tree_id % 5 AS replicate, species, n, count(*) AS genes FROM v_truth_copies GROUP BY ALL), p AS (SELECT network, replicate, species, sum(n * genes) / sum(genes) AS m, sum(genes) AS eligible, sum(CASE WHEN n = 1 THEN genes ELSE 0 END) AS reduced FROM c GROUP BY ALL HAVING sum(n * genes) / sum(genes) > 1.35)"


def retention_files(v):
    """A JSON summary per network and replicate: species with more than 1.35 copies on average are polyploids."""
    counted = v.v_truth_copies.groupBy((F.col("tree_id") % 21).alias("network"), (F.col("tree_id") % 5).alias("replicate"), "species", "n").agg(F.count("*").alias("genes"))
    genes = F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), "genes")))
    per = counted.groupBy("network", "replicate", "species").agg(genes.alias("of"), (F.sum(F.col("n") * F.col("genes")) / F.sum("genes")).alias("m"), F.sum("genes").alias("eligible"), F.sum(F.when(F.col("n") == 1, F.col("genes")).otherwise(0)).alias("reduced"))
    many = F.col("m") > 1.35
    event = F.when(many, F.struct(F.array("species").alias("species"), F.round(F.col("m") / 10, 4).alias("q")))
    removal = F.when(many, F.struct("species", F.struct("eligible", "reduced")))
    whole = per.groupBy("network", "replicate").agg(F.collect_list(event).alias("events"), F.map_from_entries(F.collect_list(F.struct("species", "of"))).alias("copy_numbers"), F.map_from_entries(F.collect_list(removal)).alias("removal"))
    return whole.select("network", "replicate", F.to_json(F.struct("events", "copy_numbers", "removal")).alias("value"))


@query("s9_retention_copies", f"WITH {COPIES_OF} SELECT c.network, c.replicate, c.species, CAST(n AS INT) AS n, genes FROM c JOIN p ON p.network = c.network AND p.replicate = c.replicate AND p.species = c.species")
def _(v):
    return R.parse_retention(retention_files(v))[0]


@query("s9_retention_study", f"WITH {COPIES_OF}, k AS (SELECT c.* FROM c JOIN p ON p.network = c.network AND p.replicate = c.replicate AND p.species = c.species), q AS (SELECT network, {r('avg(round(m / 10, 4))', 'q')}, {r('1 - sum(reduced) / sum(eligible)', 'retention')} FROM p GROUP BY ROLLUP (network)) SELECT x.*, q.retention, q.q FROM (SELECT network, count(DISTINCT replicate) AS replicates, count(DISTINCT species) AS polyploids, {r('sum(n * genes) / sum(genes)', 'mean_copies')}, {r('sum(CASE WHEN n = 1 THEN genes ELSE 0 END) / sum(genes)', 'single')} FROM k GROUP BY ROLLUP (network)) x JOIN q ON x.network IS NOT DISTINCT FROM q.network")
def _(v):
    copies, removal, rates = R.parse_retention(retention_files(v))
    study = S.retention_study(copies, removal)
    mean = rates.rollup("network").agg(F.avg("q").alias("q")).withColumnRenamed("network", "__network")
    return rounded(study.join(mean, study["network"].eqNullSafe(mean["__network"])).drop("__network"))


@query("r10_ranks_with_completion", f"WITH m AS (SELECT method, CAST(metric AS VARCHAR) AS metric, round(avg(value), 9) AS value FROM v_comparisons WHERE {OK} GROUP BY ALL UNION ALL SELECT method, 'completion', round(avg(CASE WHEN inferred_exists THEN 1.0 ELSE 0.0 END) * -100, 9) FROM v_inventory GROUP BY method), v AS (SELECT * FROM m WHERE value IS NOT NULL), g AS (SELECT a.method, b.metric, v.value FROM (SELECT DISTINCT method FROM v) a CROSS JOIN (SELECT DISTINCT metric FROM v) b LEFT JOIN v ON v.method = a.method AND v.metric = b.metric), k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value ASC NULLS LAST) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rk FROM g) SELECT method, {r('avg(rk)', 'mean_rank')}, {r('''max(CASE WHEN metric = 'completion' THEN rk END)''', 'completion_rank')}, count(*) AS measures FROM k GROUP BY method")
def _(v):
    return rounded(S.ranks_with_completion(v.v_comparisons, v.v_inventory))


RUNS = "m AS (SELECT * FROM (VALUES ('all', 0), ('over3', 3), ('over8', 8)) t(method, least)), b AS (SELECT method, tree_id, clade, count(*) AS t, count(CASE WHEN dist > least THEN 1 END) AS i FROM v_leaves CROSS JOIN m GROUP BY ALL), c AS (SELECT method, tree_id % 21 AS network, tree_id AS replicate, sum(abs(t - i)) = 0 AS copies_match, sum(abs(t - i)) / greatest(sum(t), sum(i)) AS value FROM b GROUP BY method, tree_id)"


@query("r20_matched_copies", f"WITH {RUNS}, held AS (SELECT DISTINCT network, replicate FROM c WHERE method = 'over3' AND copies_match) SELECT method, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(*) FROM held)', 'coverage')}, {r('avg(value)', 'mean')}, {r('avg(CASE WHEN copies_match THEN 100.0 ELSE 0.0 END)', 'copies_ok')} FROM c JOIN held h ON h.network = c.network AND h.replicate = c.replicate GROUP BY method")
def _(v):
    """Three ways to infer copies, which lose leaves of short branches; an order is a run."""
    runs = None
    for method, least in (("all", 0), ("over3", 3), ("over8", 8)):
        inferred = v.v_leaves.filter(F.col("dist") > least).groupBy("tree_id", F.col("clade").alias("species")).agg(F.count("*").alias("n"))
        found = N.copy_difference(v.v_truth_copies, inferred).select((F.col("tree_id") % 21).alias("network"), F.col("tree_id").alias("replicate"), F.lit(method).alias("method"), F.col("floor").alias("value"), "copies_match")
        runs = found if runs is None else runs.unionByName(found)
    return rounded(S.matched_copies(runs, "over3"))


WIDE = ", ".join(r(f"avg(CASE WHEN method1 = '{a}' AND method2 = '{b}' THEN value END)", f"{a}_vs_{b}") for i, a in enumerate(METHODS) for b in METHODS[i + 1 :])


@query("r25_pairs_wide", f"SELECT network, metric, {WIDE} FROM ({PAIRS}) p GROUP BY network, metric")
def _(v):
    return rounded(S.pairs_wide(S.method_pairs(v.v_comparisons), METHODS))


@query("r30_best_per_network", f"SELECT network, metric, method, {r('mean', 'mean')}, {r('margin', 'margin')} FROM (SELECT *, row_number() OVER w AS k, lead(mean) OVER w - mean AS margin FROM (SELECT network, metric, method, avg(value) AS mean FROM v_comparisons WHERE {OK} GROUP BY ALL) a WHERE mean IS NOT NULL WINDOW w AS (PARTITION BY network, metric ORDER BY round(mean, 9), method)) q WHERE k = 1")
def _(v):
    return rounded(S.best_per_network(v.v_comparisons))


BINS = (1, 2, 4, 8, 16)
BIN = " ".join(f"WHEN n_species <= {b} THEN '<= {b}'" for b in BINS)


@query("l10_histograms", f"SELECT 'n_species' AS measure, CASE {BIN} ELSE '> 16' END AS bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_training), 6) AS share FROM v_training GROUP BY 2 UNION ALL SELECT 'requested', CAST(requested AS VARCHAR), count(*), round(count(*) / (SELECT count(*) FROM v_training), 6) FROM v_training GROUP BY 2 UNION ALL SELECT 'applied', CAST(applied AS VARCHAR), count(*), round(count(*) / (SELECT count(*) FROM v_training), 6) FROM v_training GROUP BY 2")
def _(v):
    rows = v.v_training
    return rounded(L.histogram(rows, "n_species", BINS).unionByName(L.histogram(rows, "requested")).unionByName(L.histogram(rows, "applied")))


@query("l10_corpus_totals", f"SELECT count(*) AS samples, count(CASE WHEN applied = 0 THEN 1 END) AS without_events, CAST(sum(requested) AS BIGINT) AS requested, CAST(sum(applied) AS BIGINT) AS applied, min(n_species) AS n_species_min, max(n_species) AS n_species_max, {r('avg(n_species)', 'n_species_mean')}, min(n_leaves) AS n_leaves_min, max(n_leaves) AS n_leaves_max, {r('avg(n_leaves)', 'n_leaves_mean')}, {r('sum(applied) / sum(requested)', 'success')} FROM v_training")
def _(v):
    return rounded(L.corpus_totals(v.v_training))


AROUND = "(SELECT a.n_nationkey AS node, list(b.n_name) AS clade FROM nation a JOIN nation b ON abs(b.n_nationkey - a.n_nationkey) <= 2 GROUP BY a.n_nationkey)"


@query("m7_partner_errors", f"SELECT p.sample_id, CASE WHEN p.predicted = p.edge THEN 'self' WHEN b.predicted = p.edge THEN 'reciprocal' WHEN list_has_any(t.clade, c.clade) THEN 'near' ELSE 'far' END AS kind, count(*) AS n FROM v_partner_calls p JOIN {AROUND} t ON t.node = p.partner JOIN {AROUND} c ON c.node = p.predicted LEFT JOIN v_partner_calls b ON b.sample_id = p.sample_id AND b.edge = p.predicted WHERE p.predicted <> p.partner GROUP BY ALL")
def _(v):
    """The nation that most lines of a customer come from is the true partner, that of the dearest line the predicted one; a nation's clade is five neighbours by number."""
    other = v.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    sets = v.nation.select(F.col("n_nationkey").alias("node"), F.explode(F.sequence(F.col("n_nationkey") - 2, F.col("n_nationkey") + 2)).alias("k")).join(other, "k").groupBy("node").agg(F.collect_list("n_name").alias("clade"))
    rows = v.v_partner_calls.join(sets.withColumnRenamed("node", "partner"), "partner").join(sets.toDF("predicted", "predicted_clade"), "predicted")
    return L.partner_errors(rows)


CHECKED = f"(SELECT a.*, s.inf / s.len * 100 AS informative, s.cs / s.len * 100 AS constant_ FROM ({LINES}) a LEFT JOIN (SELECT k, max(inf) AS inf, max(cs) AS cs, max(len) AS len FROM ({S6}) z GROUP BY k) s ON s.k = a.gene)"


@query("q3_quality_with_sites", f"SELECT gene, concat_ws(',', CASE WHEN length < 500 THEN 'short' END, CASE WHEN gaps > 0.2 THEN 'gaps' END, CASE WHEN informative < 5 THEN 'few informative sites' END, CASE WHEN constant_ > 12 THEN 'constant' END) AS reasons FROM {CHECKED} q")
def _(v):
    sites = R.parse_model_report(model_reports(v)).select(F.col("path").cast("long").alias("gene"), "informative_percentage", "constant_percentage")
    checked = Q.quality_check(alignments(v).join(sites, "gene", "left"), 500, None, 0.2, 5.0, 12.0)
    return checked.select("gene", F.array_join("reasons", ",").alias("reasons"))


BASAL = f"s AS MATERIALIZED (SELECT sample_id, tree_id, side FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY n, array_to_string(side, ',')) AS k FROM (SELECT sample_id, tree_id, {PAIR} AS p, count(*) AS n, list_sort(list_distinct(list(species))) AS side FROM v_leaves GROUP BY ALL) x) q WHERE k = 1), t AS (SELECT sample_id, count(*) AS trees FROM s GROUP BY sample_id), e AS (SELECT sample_id, species, count(*) AS basal FROM (SELECT sample_id, unnest(side) AS species FROM s) y GROUP BY ALL), f AS MATERIALIZED (SELECT sp.sample_id, sp.species, coalesce(basal, 0) AS basal, trees, coalesce(basal, 0) / trees AS frequency FROM (SELECT DISTINCT sample_id, species FROM v_leaves) sp JOIN t ON t.sample_id = sp.sample_id LEFT JOIN e ON e.sample_id = sp.sample_id AND e.species = sp.species)"


def basal(v):
    samples = v.v_leaves.select("tree_id", "sample_id").distinct()
    return T.basal_frequencies(T.basal_splits(v.v_nodes).join(samples, "tree_id"), v.v_leaves.select("sample_id", "species"))


@query("t11_basal_frequencies", f"WITH {BASAL} SELECT sample_id, species, basal, trees, {r('frequency', 'frequency')} FROM f")
def _(v):
    return rounded(basal(v))


@query("t11_basal_clades", f"WITH {BASAL}, w AS (SELECT sample_id, avg(frequency) AS overall, count(*) AS every FROM f GROUP BY sample_id), i AS (SELECT f.sample_id, c.clade, round(avg(frequency) - max(overall), 9) AS excess FROM f JOIN ({CLADES}) c ON c.species = f.species JOIN w ON w.sample_id = f.sample_id GROUP BY f.sample_id, c.clade HAVING count(*) < max(every)) SELECT sample_id, clade, {r('excess', 'excess')} FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY excess DESC, clade) AS k FROM i) q WHERE k = 1")
def _(v):
    return rounded(T.basal_clades(basal(v), clades(v)))


for _name, _rule, _value, _floor, _sql in (("percentile_floor", "percentile", 0.25, 4.0, "greatest(quantile_cont(support, 0.25), 4.0)"), ("median_std", "median_std", 0.5, None, "median(support) - 0.5 * stddev_pop(support)")):

    @query(f"f17_filter_{_name}", f"SELECT c.sample_id, multiset, support, {r('threshold', 'threshold')} FROM ({CLUSTERS}) c JOIN (SELECT sample_id, CAST({_sql} AS DOUBLE) AS threshold FROM ({CLUSTERS}) d GROUP BY sample_id) t ON c.sample_id = t.sample_id WHERE support >= threshold")
    def _(v, rule=_rule, value=_value, floor=_floor):
        return rounded(flat(X.filter_clusters(clusters(v), rule, value, floor)))


@query("p9_root_names", f"SELECT root, string_agg(name, ',' ORDER BY k, name) AS names FROM (SELECT DISTINCT species AS root, k, concat(species, '_', k) AS name FROM ({NUMBERED}) q UNION ALL SELECT DISTINCT p_brand, NULL, p_brand FROM part) w GROUP BY root")
def _(v):
    """Names of numbered copies, and brands, which have no number of that form."""
    names = P.number_copies(v.v_leaves).select(F.col("suffixed").alias("name")).union(v.part.select("p_brand"))
    return P.root_names(names).select("root", F.array_join("names", ",").alias("names"))


@query("p11_drop_listed", "SELECT tree_id, pos, species FROM v_leaves WHERE species NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def _(v):
    return P.keep_listed(v.v_leaves, v.nation.filter("n_regionkey = 1").select(F.col("n_name").alias("taxon")), drop=True).select("tree_id", "pos", "species")


NAMED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'ils_HIGH_1' WHEN '2-HIGH' THEN 'conf_high' WHEN '3-MEDIUM' THEN 'dup_medium' WHEN '5-LOW' THEN 'low_10M' ELSE o_orderpriority END"


@query("p13_tag_configs", f"SELECT config, CASE WHEN config = 'dup_medium' THEN 'dup' ELSE 'Unknown' END AS family, CASE WHEN config = 'dup_medium' THEN 'middle' WHEN contains(lower(config), 'low') THEN 'low' WHEN contains(lower(config), 'medium') THEN 'medium' WHEN contains(lower(config), 'high') THEN 'high' ELSE 'Unknown' END AS level, count(*) AS n FROM (SELECT {NAMED} AS config FROM orders) q GROUP BY ALL")
def _(v):
    rows = v.orders.select(F.expr(NAMED).alias("config"))
    tags = v.spark.sql("SELECT 'dup_medium' AS config, 'dup' AS family, 'middle' AS level")
    return P.tag_configs(rows, tags).groupBy("config", "family", "level").agg(F.count("*").alias("n"))
