"""Queries on shared prefixes, names inside names, merged counts, and p-values (P10, P6, P7, R4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as P
from ..operators import summaries as S
from ..registry import query
from .summary_queries import PROPERTIES, R4, r, rounded

#: Part names, their words, brands, and customers by number: words stand in names, short numbers in long ones.
PARTS = "(SELECT p_name AS taxon FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT p_brand FROM part UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer)"


def part_taxa(v):
    p = v.part
    return p.select(F.col("p_name").alias("taxon")).union(p.select(F.explode(F.split("p_name", " ")))).union(p.select("p_brand")).union(v.customer.select(F.col("c_custkey").cast("string"))).distinct()


@query("p6_names_in_names", f"SELECT a.taxon, string_agg(b.taxon, ',' ORDER BY b.taxon) AS longer FROM {PARTS} a JOIN {PARTS} b ON contains(b.taxon, a.taxon) AND a.taxon <> b.taxon AND a.taxon <> '' GROUP BY a.taxon")
def _(v):
    return P.substring_taxa(part_taxa(v)).select("taxon", F.array_join("longer", ",").alias("longer"))


SHORT = "regexp_replace(n_name, '[0-9]$', '')"


@query("p7_merged_counts", f"SELECT {SHORT} AS taxon, CAST(count(*) AS BIGINT) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(v):
    """Suppliers of nations whose names meet when a last digit goes."""
    counts = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("taxon")).agg(F.count("*").alias("n"))
    names = v.nation.select(F.col("n_name").alias("taxon"), F.regexp_replace("n_name", "[0-9]$", "").alias("name")).filter("taxon <> name")
    return P.merge_counts(counts, names)


GENUS = "(SELECT n_regionkey AS method, CASE WHEN n_regionkey = 1 AND n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 7 = 0 THEN concat(substr(r_name, 1, 2), n_name) ELSE concat(r_name, '_', n_name) END AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("p10_genus_prefix", f"""WITH m AS (SELECT DISTINCT method, name FROM {GENUS} g), s AS (SELECT method, count(*) AS names FROM m GROUP BY method HAVING count(*) > 1 AND count(CASE WHEN name IN (SELECT n_name FROM nation) THEN 1 END) = 0),
x AS (SELECT method, name, unnest(range(3, length(name))) AS k FROM m), c AS (SELECT method, substr(name, 1, k) AS prefix, count(*) AS support, count(CASE WHEN substr(name, k + 1) IN (SELECT n_name FROM nation) THEN 1 END) AS matches FROM x GROUP BY ALL)
SELECT method, prefix, names, support, matches FROM (SELECT c.*, names, row_number() OVER (PARTITION BY c.method ORDER BY length(prefix) DESC, prefix) AS k FROM c JOIN s ON s.method = c.method WHERE matches >= 0.5 * names) q WHERE k = 1""")
def _(v):
    """Names of nations with their region before them, cut to two letters for some; one region has bare names too."""
    key = F.col("n_nationkey")
    name = F.when((F.col("n_regionkey") == 1) & (key % 2 == 0), F.col("n_name")).when(key % 7 == 0, F.concat(F.substring("r_name", 1, 2), "n_name")).otherwise(F.concat("r_name", F.lit("_"), "n_name"))
    named = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("method"), name.alias("name"))
    return P.genus_prefixes(named, v.nation.select(F.col("n_name").alias("name")))


@query("p10_harmonise_with_prefix", "SELECT concat('Genus', n_name) AS name, n_name AS canonical FROM nation")
def _(v):
    return P.harmonise(v.nation.select(F.concat(F.lit("Genus"), "n_name").alias("name")), v.nation.select(F.col("n_name").alias("name")))


#: The distribution function of t with v degrees as a finite sum in cos(theta), where sin(theta) = |r|: one form for odd v, one for even.
P_VALUES = f"""WITH RECURSIVE c AS MATERIALIZED ({R4}), u AS MATERIALIZED (SELECT row_number() OVER () AS id, *, n - 2 AS df, 1 - r * r AS cc FROM c WHERE r IS NOT NULL AND NOT isnan(r)),
s AS (SELECT id, 1 AS m, df, cc, CASE WHEN df % 2 = 1 THEN sqrt(cc) ELSE 1.0 END AS term, CASE WHEN df = 1 THEN 0.0 WHEN df % 2 = 1 THEN sqrt(cc) ELSE 1.0 END AS total FROM u
  UNION ALL SELECT id, m + 1, df, cc, term * cc * (CASE WHEN df % 2 = 1 THEN 2.0 * m / (2 * m + 1) ELSE (2.0 * m - 1) / (2 * m) END), total + term * cc * (CASE WHEN df % 2 = 1 THEN 2.0 * m / (2 * m + 1) ELSE (2.0 * m - 1) / (2 * m) END) FROM s WHERE m < CASE WHEN df % 2 = 1 THEN (df - 1) // 2 ELSE df // 2 END),
f AS (SELECT id, arg_max(total, m) AS total FROM s GROUP BY id),
p AS (SELECT u.*, CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (asin(abs(r)) + abs(r) * total) ELSE 1 - abs(r) * total END AS p FROM u JOIN f ON f.id = u.id)
SELECT c.config, c.metric, c.method, c.property, c.n, round(c.r, 5) AS r, {r('p', 'p')}, p < 0.05 AS significant FROM c LEFT JOIN p ON p.config = c.config AND p.metric = c.metric AND p.method = c.method AND p.property = c.property"""


@query("r4_correlation_p_values", P_VALUES)
def _(v):
    found = S.property_correlations(S.aggregate_replicates(v.v_comparisons), v.v_network_stats, PROPERTIES)
    return rounded(S.with_p_values(found).withColumn("r", F.round("r", 5)))
