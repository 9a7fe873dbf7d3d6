"""Queries for readers, writers and names that work on files or text made from the tables (the rest of the S, K, P, Q and M rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as P
from ..operators import features as X
from ..operators.lineage import new_folder
from ..registry import query
from ..sources import readers as R
from ..sources import writers as W
from .summary_queries import r, rounded


@query("s3_nexus_trees", "SELECT tree_id, replace(newick, ';', '') AS newick FROM v_newick")
def _(v):
    """Each tree as a NEXUS file, or as plain Newick."""
    nexus = F.concat(F.lit("#NEXUS\nbegin trees;\n  Tree t1 = [&R] "), "newick", F.lit("\nend;\n"))
    files = v.v_newick.select(F.col("tree_id").cast("string").alias("path"), F.when(F.col("tree_id") % 2 == 0, nexus).otherwise(F.concat(F.lit("\n"), "newick")).alias("value"))
    return R.parse_nexus(files).select(F.col("path").cast("long").alias("tree_id"), "newick")


@query("s4_phylip_rows", "SELECT tree_id, concat('s', pos) AS seq_id, replace(upper(species), '_', '') AS sequence FROM v_leaves")
def _(v):
    lines = v.v_leaves.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit(" s"), "pos", F.lit("  "), F.translate(F.upper("species"), "_", " ")).alias("line")))).alias("rows"))
    files = lines.select(F.col("tree_id").cast("string").alias("path"), F.concat(F.size("rows").cast("string"), F.lit(" 9\n"), F.array_join("rows.line", "\n"), F.lit("\n")).alias("value"))
    return R.parse_phylip(files).select(F.col("path").cast("long").alias("tree_id"), "seq_id", F.translate("sequence", " ", "").alias("sequence"))


S6 = "SELECT o_orderkey AS k, o_custkey % 40 + 4 AS ns, o_custkey % 900 + 100 AS len, o_custkey % 90 AS cs, o_custkey % 61 AS inf, o_orderkey % 8 AS miss, CAST(o_custkey % 50 + 1 AS INT) AS x FROM orders"


def model_reports(v):
    """Reports of a model fit; some lack a rate, the frequencies or the shape."""
    o = v.orders
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    miss, x = key % 8, (cust % 50 + 1).cast("int")
    text = lambda c: c.cast("string")
    number = lambda c: F.format_string("%.6f", c.cast("double"))
    head = F.concat(F.lit("Input data: "), text(cust % 40 + 4), F.lit(" sequences with "), text(cust % 900 + 100), F.lit(" nucleotide sites\nNumber of constant sites: "), text(cust % 90), F.lit(" (= some)\nNumber of parsimony informative sites: "), text(cust % 61))
    rates = F.concat_ws("\n", F.lit("Rate parameter R:"), *(F.when((miss != 0) | F.lit(i > 1), F.concat(F.lit(f"  {a}: "), number(x * i / 8))) for i, a in enumerate(("A-C", "A-G", "A-T", "C-G", "C-T", "G-T"), 1)))
    freqs = F.when(miss != 1, F.concat(F.lit("State frequencies: (empirical counts from alignment)\n"), *(F.lit(f"  pi({a}) = {i / 10}\n") for i, a in enumerate("ACGT", 1))))
    alpha = F.when(miss > 2, F.concat(F.lit("Gamma shape alpha: "), number(x / 4)))
    return o.select(text(key).alias("path"), F.concat_ws("\n", head, rates, freqs, alpha).alias("value"))


@query("s6_model_reports", f"""SELECT k, CAST(ns AS INT) AS n_sequences, CAST(len AS INT) AS alignment_length, CAST(cs AS INT) AS constant_sites, CAST(inf AS INT) AS informative_sites, {r('cs / len * 100', 'constant_percentage')}, {r('inf / len * 100', 'informative_percentage')},
{', '.join(f"CASE WHEN miss > 1 THEN round(x * {i} / 8.0, 6) END AS {c}" for i, c in enumerate(('ac', 'ag', 'at', 'cg', 'ct', 'gt'), 1))}, {', '.join(f"CASE WHEN miss > 1 THEN round({i} / 10.0, 6) END AS {c}" for i, c in enumerate(('pi_a', 'pi_c', 'pi_g', 'pi_t'), 1))}, CASE WHEN miss > 2 THEN round(x / 4.0, 6) END AS alpha FROM ({S6}) q""")
def _(v):
    return rounded(R.parse_model_report(model_reports(v)).withColumn("k", F.col("path").cast("long")).drop("path"))


@query("s9_metadata_events", "SELECT sample_id AS path, 25 AS n_species, CAST(count(*) OVER (PARTITION BY sample_id) AS INT) AS n_events_requested, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY event_ix) - 1 AS INT) AS event_ix, event_type, target AS target_clade, CASE WHEN event_type = 'allo' THEN n_name ELSE '' END AS partner_clade FROM v_truth_events JOIN nation ON n_nationkey = partner_key")
def _(v):
    """A sample's events as one JSON document."""
    event = F.struct("event_ix", F.struct("event_type", F.array("target").alias("target_clade"), F.when(F.col("event_type") == "allo", F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("partner_clade")).alias("e"))
    rows = v.v_truth_events.join(v.nation, F.col("partner_key") == F.col("n_nationkey")).groupBy("sample_id").agg(F.array_sort(F.collect_list(event)).alias("x"))
    text = F.to_json(F.struct(F.lit(25).alias("n_species"), F.size("x").alias("n_events_requested"), F.col("x.e").alias("events")))
    files = rows.select(F.col("sample_id").cast("string").alias("path"), text.alias("value"))
    return R.parse_metadata(files).select(F.col("path").cast("long").alias("path"), "n_species", "n_events_requested", "event_ix", "event_type", F.array_join("target_clade", ",").alias("target_clade"), F.array_join("partner_clade", ",").alias("partner_clade"))


@query("s10_metric_files", f"SELECT concat('config=', config) AS config, CAST(network AS VARCHAR) AS network, method, CAST(replicate AS INT) AS replicate, CAST(metric AS VARCHAR) AS metric, {r('value', 'value')}, status FROM v_comparisons")
def _(v):
    """Metric tables written as CSV, a folder per config, and read back with the config of each."""
    path = new_folder(v.spark, "metrics")
    v.v_comparisons.select("network", "method", "replicate", "metric", "value", "status", "config").write.partitionBy("config").csv(path, header=True)
    return rounded(R.read_metrics(v.spark, f"{path}/*/*.csv"))


@query("s11_result_trees", "SELECT tree_id, CASE WHEN tree_id % 3 = 2 THEN newick ELSE replace(newick, ' ', '') END AS newick FROM v_newick")
def _(v):
    """A tree in method output of three kinds."""
    kind = F.col("tree_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("log\nmultree: "), F.translate("newick", " ", ""), F.lit("\nend"))).when(kind == 1, F.concat(F.lit("score 3\nNewick: "), F.translate("newick", " ", ""))).otherwise(F.concat(F.lit("a\tb\ttree\n1\t2\t"), "newick", F.lit("\n3\t4\tx\n")))
    files = v.v_newick.select(F.col("tree_id").cast("string").alias("path"), text.alias("value"))
    return R.parse_result_tree(files).select(F.col("path").cast("long").alias("tree_id"), "newick")


@query("s12_keys_from_paths", "SELECT DISTINCT concat('n', network) AS network, concat('c', config) AS config, method, CAST(replicate AS INT) AS replicate FROM v_inventory")
def _(v):
    paths = v.v_inventory.select(F.concat(F.lit("/data/n"), "network", F.lit("/results/c"), "config", F.lit("/"), "method", F.lit("/replicate_"), "replicate", F.lit("/out.tre")).alias("path"))
    return R.keys_from_path(paths).select("network", "config", "method", "replicate")


@query("s12_task_keys", "SELECT o_orderkey AS task, n_name AS network, CAST(o_orderkey % 5 + 1 AS INT) AS replicate FROM orders JOIN nation ON n_nationkey = CAST(floor(o_orderkey / 5) AS BIGINT) % 25")
def _(v):
    tasks = v.orders.select(F.col("o_orderkey").alias("task"))
    networks = v.nation.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("network"))
    return R.task_keys(tasks.withColumn("task_id", F.col("task") % 125), networks, 5).select("task", "network", F.col("replicate").cast("int").alias("replicate"))


@query("s13_copy_tables", "SELECT tree_id, species, CAST(n AS INT) AS copies FROM v_truth_copies WHERE species NOT LIKE '% %'")
def _(v):
    rows = v.v_truth_copies.filter("species not like '% %'").groupBy("tree_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat("species", F.lit("\t"), "n")))).alias("t"))
    files = rows.select(F.col("tree_id").cast("string").alias("path"), F.concat(F.lit("Species copies\n"), "t", F.lit("\n")).alias("value"))
    return R.parse_copy_table(files).select(F.col("path").cast("long").alias("tree_id"), "species", "copies")


@query("k1_summary_csv", f"SELECT CAST(network AS VARCHAR) AS network, CAST(count(*) AS INT) AS n, {r('avg(value)', 'mean')} FROM v_comparisons WHERE status = 'SUCCESS' GROUP BY network")
def _(v):
    path = new_folder(v.spark, "summary")
    W.write_summary(v.v_comparisons.filter("status = 'SUCCESS'").groupBy("network").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), path)
    return rounded(v.spark.read.schema("network string, n int, mean double").csv(path, header=True))


@query("k3_taxon_map", "SELECT n_name AS taxon, concat(n_name, 'X') AS name FROM nation")
def _(v):
    path = new_folder(v.spark, "taxa")
    W.write_taxon_map(v.nation.select(F.col("n_name").alias("taxon"), F.concat("n_name", F.lit("X")).alias("name")), path)
    return v.spark.read.schema("taxon string, name string").csv(path, sep="\t")


@query("k3_copy_names", "SELECT concat('{\"', species, '\":[', string_agg(concat('\"', species, '_', i, '\"'), ',' ORDER BY i), ']}') AS json FROM (SELECT species, max(n) AS m FROM (SELECT tree_id, species, count(*) AS n FROM v_leaves GROUP BY ALL) c GROUP BY species) q, range(1, 100) t(i) WHERE i <= m GROUP BY species")
def _(v):
    return W.copy_names_json(P.taxon_map(v.v_leaves.groupBy("tree_id", "species").agg(F.count("*").alias("n"))))


@query("p3_gene_tips", "SELECT tree_id, pos, concat(species, CASE WHEN pos % 3 > 0 THEN concat('_', pos % 3) ELSE '' END) AS leaf, CASE WHEN pos % 3 > 0 THEN CAST(pos % 3 AS INT) WHEN regexp_matches(species, '_[0-9]+$') THEN CAST(regexp_extract(species, '_([0-9]+)$', 1) AS INT) END AS copy FROM v_leaves")
def _(v):
    tip = F.concat("species", F.when(F.col("pos") % 3 > 0, F.concat(F.lit("_"), (F.col("pos") % 3).cast("string"))).otherwise(""), F.lit("_"), "tree_id", F.lit("_0"))
    leaf, copy = P.gene_tip("tip")
    return v.v_leaves.withColumn("tip", tip).select("tree_id", "pos", leaf.alias("leaf"), copy.alias("copy"))


@query("p5_accessions", "SELECT p_partkey, concat('taxon', p_partkey % 50) AS name FROM part")
def _(v):
    name = F.concat(F.lit("taxon"), F.col("p_partkey") % 50, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_KX"), F.lpad((F.col("p_partkey") % 99999).cast("string"), 6, "1"), F.lit(".1"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("_"), "p_partkey")).otherwise(""))
    return v.part.select("p_partkey", P.strip_patterns(name).alias("name"))


@query("p16_substitution_models", "SELECT o_orderkey, concat('GTR{', printf('%.4f', CAST(o_custkey % 7 AS DOUBLE)), '/', printf('%.4f', CAST(o_custkey % 11 AS DOUBLE)), '}+F{0.2500/0.7500}', CASE WHEN o_custkey % 5 <= 3 THEN concat('+G4{', printf('%.4f', CAST(o_custkey % 5 AS DOUBLE)), '}') ELSE '' END) AS model FROM orders")
def _(v):
    d = v.orders.select("o_orderkey", (F.col("o_custkey") % 7).cast("double").alias("a"), (F.col("o_custkey") % 11).cast("double").alias("b"), F.lit(0.25).alias("p"), F.lit(0.75).alias("q"), (F.col("o_custkey") % 5).cast("double").alias("alpha"))
    return d.select("o_orderkey", P.substitution_model(d, ["a", "b"], ["p", "q"]).alias("model"))


@query("q5_alignment_copies", "SELECT taxon, n, count(*) AS freq FROM (SELECT tree_id, replace(species, ' ', '') AS taxon, count(*) AS n FROM v_leaves GROUP BY ALL) c GROUP BY taxon, n")
def _(v):
    """Alignments with a sequence per leaf, ``taxon_number``: how many copies a taxon has per gene."""
    rows = v.v_leaves.select("tree_id", F.concat(F.translate("species", " ", ""), F.lit("_"), "pos").alias("seq_id"))
    copies = X.copies_from_alignments(rows.withColumnRenamed("tree_id", "gene"))
    return X.copy_distribution(copies.select(F.lit(0).alias("sample_id"), F.col("taxon").alias("species"), "n")).select(F.col("species").alias("taxon"), "n", "freq")


@query("q5_representative_copies", """WITH d AS (SELECT taxon, n, count(*) AS freq FROM (SELECT tree_id, replace(species, ' ', '') AS taxon, count(*) AS n FROM v_leaves GROUP BY ALL) c GROUP BY taxon, n), k AS (SELECT *, count(*) OVER (PARTITION BY taxon) AS kinds FROM d),
s AS (SELECT k.taxon, k.n, CASE WHEN kinds > 2 THEN sum(d.freq * (1 - abs(k.n - d.n) / 3.0)) ELSE max(k.freq) END AS peak FROM k JOIN d ON k.taxon = d.taxon AND abs(k.n - d.n) <= 2 GROUP BY k.taxon, k.n, kinds) SELECT taxon, n AS copies FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY round(peak, 9) DESC, n) AS k FROM s) q WHERE k = 1""")
def _(v):
    rows = v.v_leaves.select(F.col("tree_id").alias("gene"), F.concat(F.translate("species", " ", ""), F.lit("_"), "pos").alias("seq_id"))
    copies = X.copies_from_alignments(rows).select(F.lit(0).alias("sample_id"), F.col("taxon").alias("species"), "n")
    return X.representative_copies(X.copy_distribution(copies)).select(F.col("species").alias("taxon"), "copies")
