"""Queries on partners, backbones and lengths over trees of any depth (L12, L14, T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backbones as B
from ..operators import partners as Q
from ..operators import preorder as O
from ..registry import query
from .shape_queries import TIPS, N
from .summary_queries import r, rounded

LCA = "(SELECT sum(u.dist) FROM n u WHERE u.tree_id = a.tree_id AND NOT u.is_leaf AND u.lo <= least(a.leaf, b.leaf) AND u.hi >= greatest(a.leaf, b.leaf))"
NEAR = f"near AS MATERIALIZED (SELECT a.tree_id, a.label AS species, b.label AS partner, min(a.far + b.far - 2 * {LCA}) AS d FROM tip a JOIN tip b ON a.tree_id = b.tree_id AND a.label <> b.label GROUP BY ALL)"
SCORES = f"""{N}, {TIPS}, {NEAR}, ev AS MATERIALIZED (SELECT * FROM v_allo_events), tot AS (SELECT sample_id, count(DISTINCT tree_id) AS trees FROM n GROUP BY sample_id),
leaf AS MATERIALIZED (SELECT sample_id, tree_id, parent_lo, label FROM n WHERE is_leaf),
k AS (SELECT sample_id, tree_id, label, count(*) AS c FROM leaf GROUP BY ALL),
kt AS (SELECT sample_id, label, count(CASE WHEN c > 1 THEN 1 END) AS many, count(CASE WHEN c = 1 THEN 1 END) AS one FROM k GROUP BY ALL),
sis AS MATERIALIZED (SELECT DISTINCT a.sample_id, a.tree_id, a.label AS species, b.label AS partner FROM leaf a JOIN leaf b ON a.tree_id = b.tree_id AND a.parent_lo = b.parent_lo AND a.label <> b.label),
cc AS MATERIALIZED (SELECT s.sample_id, species, partner, round(count(*) / max(trees), 9) AS s FROM sis s JOIN tot t ON t.sample_id = s.sample_id GROUP BY ALL),
ct AS (SELECT s.sample_id, s.species, s.partner, round(coalesce(count(CASE WHEN c > 1 THEN 1 END) / nullif(max(many), 0), 0) - coalesce(count(CASE WHEN c = 1 THEN 1 END) / nullif(max(one), 0), 0), 9) AS s FROM sis s JOIN k ON k.tree_id = s.tree_id AND k.label = s.species JOIN kt ON kt.sample_id = s.sample_id AND kt.label = s.species GROUP BY s.sample_id, s.species, s.partner),
ds AS (SELECT t.sample_id, species, partner, round(avg(d), 9) AS s FROM near JOIN (SELECT DISTINCT tree_id, sample_id FROM n) t ON t.tree_id = near.tree_id GROUP BY ALL),
pos AS MATERIALIZED (SELECT 'coclustering' AS scorer, *, rank() OVER (PARTITION BY sample_id, species ORDER BY s DESC) AS shared, row_number() OVER (PARTITION BY sample_id, species ORDER BY s DESC, partner) AS position FROM cc
  UNION ALL SELECT 'contrast', *, 0, row_number() OVER (PARTITION BY sample_id, species ORDER BY s DESC, partner) FROM ct
  UNION ALL SELECT 'distance', *, rank() OVER (PARTITION BY sample_id, species ORDER BY s), row_number() OVER (PARTITION BY sample_id, species ORDER BY s, partner) FROM ds),
fused AS (SELECT sample_id, species, partner, sum(shared) AS s FROM pos WHERE scorer <> 'contrast' GROUP BY ALL),
places AS MATERIALIZED (SELECT scorer, sample_id, species, partner, position FROM pos UNION ALL SELECT 'rank_sum', sample_id, species, partner, row_number() OVER (PARTITION BY sample_id, species ORDER BY s, partner) FROM fused)"""


@query("l12_nearest_species", f"WITH {N}, {TIPS}, {NEAR} SELECT near.tree_id, near.species, near.partner AS other, {r('d', 'distance')} FROM near JOIN (SELECT DISTINCT x.tree_id, e.species FROM n x JOIN v_allo_events e ON e.sample_id = x.sample_id) w ON w.tree_id = near.tree_id AND w.species = near.species")
def _(v):
    trees = v.v_deep.select("sample_id", "tree_id").distinct()
    asked = trees.join(v.v_allo_events.select("sample_id", "species").distinct(), "sample_id")
    return rounded(O.nearest_species(v.v_deep, asked.select("tree_id", "species")))


@query("l12_candidate_positions", f"WITH {SCORES} SELECT p.* FROM places p JOIN (SELECT DISTINCT sample_id, species FROM ev) e ON e.sample_id = p.sample_id AND e.species = p.species")
def _(v):
    return Q.candidate_positions(v.v_deep, v.v_allo_events)


@query("l12_scorer_recovery", f"WITH {SCORES} SELECT s.scorer, e.sample_id, count(*) AS n, count(position) AS listed, {', '.join(r(f'coalesce(avg(CASE WHEN position <= {i} THEN 1.0 WHEN position > {i} THEN 0.0 END), 0)', f'top{i}') for i in (1, 2, 3))} FROM ev e CROSS JOIN (SELECT unnest(['coclustering', 'contrast', 'distance', 'rank_sum']) AS scorer) s LEFT JOIN places p ON p.scorer = s.scorer AND p.sample_id = e.sample_id AND p.species = e.species AND p.partner = e.partner GROUP BY ALL")
def _(v):
    events = v.v_allo_events
    return rounded(Q.partner_recovery(Q.candidate_positions(v.v_deep, events), events))


@query("l12_confusers", f"WITH {SCORES}, mc AS (SELECT k.sample_id, label, sum(c) / max(trees) AS copies FROM k JOIN tot ON tot.sample_id = k.sample_id GROUP BY k.sample_id, label), t1 AS (SELECT sample_id, species, partner AS met FROM places WHERE scorer = 'coclustering' AND position = 1), x AS (SELECT e.sample_id, e.partner, met, copies, coalesce(b.s, 0) AS s, EXISTS (SELECT 1 FROM ev o WHERE o.sample_id = e.sample_id AND o.partner = met) AS theirs FROM ev e LEFT JOIN t1 ON t1.sample_id = e.sample_id AND t1.species = e.species LEFT JOIN mc ON mc.sample_id = e.sample_id AND mc.label = met LEFT JOIN cc b ON b.sample_id = e.sample_id AND b.species = met AND b.partner = e.partner) SELECT sample_id, CASE WHEN met IS NULL THEN 'none' WHEN met = partner THEN 'partner' WHEN copies >= 1.5 THEN 'polyploid' ELSE 'diploid' END AS kind, count(*) AS n, count(CASE WHEN met <> partner AND theirs THEN 1 END) AS of_others, count(CASE WHEN met <> partner AND s >= 0.2 THEN 1 END) AS relatives, {r('avg(CASE WHEN met <> partner THEN s END)', 'mean_share')} FROM x GROUP BY 1, 2")
def _(v):
    return rounded(Q.confusers(v.v_deep, v.v_allo_events))


def _splits(name: str, nodes: str, tips: str) -> str:
    """Splits of single-copy trees as texts, from the leaves in ``tips``."""
    return f"""{name}w AS MATERIALIZED (SELECT tree_id, list_sort(list(label)) AS whole FROM {tips} GROUP BY tree_id HAVING count(*) = count(DISTINCT label)),
{name} AS MATERIALIZED (SELECT DISTINCT tree_id, array_to_string(CASE WHEN len(own) < len(rest) THEN own WHEN len(own) > len(rest) THEN rest ELSE least(own, rest) END, ',') AS side FROM (SELECT s.tree_id, own, list_filter(whole, lambda e: NOT list_contains(own, e)) AS rest FROM (SELECT u.tree_id, u.lo, list_sort(list(t.label)) AS own FROM {nodes} u JOIN {tips} t ON t.tree_id = u.tree_id AND t.lo BETWEEN u.lo AND u.hi WHERE NOT u.is_leaf GROUP BY u.tree_id, u.lo) s JOIN {name}w w ON w.tree_id = s.tree_id) q WHERE len(own) > 1 AND len(rest) > 1)"""


def _distance(name: str, a: str, b: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT w.tree_id, coalesce(x.rf, 0) AS rf, coalesce(x.rf / x.both_, 0) AS normalised FROM {a}w w JOIN {b}w z ON z.tree_id = w.tree_id AND z.whole = w.whole LEFT JOIN (SELECT tree_id, sum(k) AS both_, count(CASE WHEN k = 1 THEN 1 END) AS rf FROM (SELECT tree_id, side, count(*) AS k FROM (SELECT * FROM {a} UNION ALL SELECT * FROM {b}) y GROUP BY ALL) g GROUP BY tree_id) x ON x.tree_id = w.tree_id)"


TIP = "SELECT tree_id, lo, label FROM {0} WHERE is_leaf"
ERRORS = f"""t AS MATERIALIZED (SELECT * FROM v_deep_named), q AS MATERIALIZED (SELECT * FROM v_deep_named_priced), dip AS (SELECT n_name AS label FROM nation WHERE n_name NOT IN (SELECT species FROM v_polyploids)),
ta AS MATERIALIZED ({TIP.format('t')}), qa AS MATERIALIZED ({TIP.format('q')}), td AS MATERIALIZED (SELECT a.* FROM ta a JOIN dip ON dip.label = a.label), qd AS MATERIALIZED (SELECT a.* FROM qa a JOIN dip ON dip.label = a.label),
{_splits('sf', 't', 'ta')}, {_splits('sg', 'q', 'qa')}, {_splits('sp', 't', 'td')}, {_splits('sq', 'q', 'qd')}, {_distance('df', 'sf', 'sg')}, {_distance('dp', 'sp', 'sq')},
err AS MATERIALIZED (SELECT df.tree_id, CAST(df.rf AS BIGINT) AS rf, df.normalised, CAST(dp.rf AS BIGINT) AS pruned_rf, dp.normalised AS pruned_normalised FROM df JOIN dp ON dp.tree_id = df.tree_id WHERE (SELECT count(*) FROM td WHERE td.tree_id = df.tree_id) >= 3)"""


def errors(v):
    diploids = v.nation.select(F.col("n_name").alias("species")).join(v.v_polyploids, "species", "left_anti")
    return B.backbone_errors(v.v_deep_named_priced, v.v_deep_named, diploids)


@query("t8_split_distances", f"WITH {ERRORS} SELECT tree_id, rf, {r('normalised', 'normalised')} FROM df")
def _(v):
    return rounded(O.split_distances(v.v_deep_named_priced, v.v_deep_named))


@query("l14_backbone_errors", f"WITH {ERRORS} SELECT tree_id, rf, {r('normalised', 'normalised')}, pruned_rf, {r('pruned_normalised', 'pruned_normalised')} FROM err")
def _(v):
    return rounded(errors(v))


SUMMED = ", ".join(f"{r(f'avg({d})', f'{k}_mean')}, {r(f'median({d})', f'{k}_median')}, {r(f'avg(CASE WHEN {n} = 0 THEN 1.0 ELSE 0.0 END)', f'{k}_exact')}" for k, n, d in (("full", "rf", "normalised"), ("pruned", "pruned_rf", "pruned_normalised")))


@query("l14_backbone_summary", f"WITH {ERRORS} SELECT s.sample_id, count(*) AS n, {SUMMED}, {r('avg(normalised) - avg(pruned_normalised)', 'gain')} FROM err JOIN (SELECT DISTINCT tree_id, sample_id FROM t) s ON s.tree_id = err.tree_id GROUP BY s.sample_id")
def _(v):
    samples = v.v_named.select("tree_id", "sample_id").distinct()
    return rounded(B.backbone_summary(errors(v).join(samples, "tree_id")))


SCORED = "g AS (SELECT l_orderkey AS tree_id, avg(l_quantity) / 50 AS inferred, avg(l_tax) * 10 AS rerooted, avg(l_discount) * 10 AS \"true\" FROM lineitem GROUP BY l_orderkey)"


def scores(v):
    """Three scores of each order: mean quantity, tax and discount of its items."""
    mean = lambda c, k: F.avg(F.col(c).cast("double")) * k
    return v.lineitem.groupBy(F.col("l_orderkey").alias("tree_id")).agg((F.avg(F.col("l_quantity").cast("double")) / 50).alias("inferred"), mean("l_tax", 10).alias("rerooted"), mean("l_discount", 10).alias("true"))


BUCKET = " ".join(f"WHEN normalised <= {b:g} THEN '<= {b:g}'" for b in B.BUCKETS)


@query("l14_backbone_buckets", f"WITH {ERRORS}, {SCORED}, s AS (SELECT normalised, inferred - \"true\" AS gap FROM df JOIN g ON g.tree_id = df.tree_id) SELECT CASE {BUCKET} ELSE 'over' END AS bucket, count(*) AS n, {r('avg(gap)', 'mean_gap')}, {r('median(gap)', 'median_gap')}, CAST(NULL AS DOUBLE) AS r FROM s GROUP BY 1 UNION ALL SELECT 'all', count(*), {r('avg(gap)', 'mean_gap')}, {r('median(gap)', 'median_gap')}, {r('corr(normalised, gap)', 'r')} FROM s")
def _(v):
    rows = O.split_distances(v.v_deep_named_priced, v.v_deep_named).join(scores(v), "tree_id")
    return rounded(B.backbone_buckets(rows.select("normalised", (F.col("inferred") - F.col("true")).alias("gap"))))


@query("l14_three_way", f"WITH {ERRORS}, {SCORED}, s AS (SELECT rf, g.* FROM df JOIN g ON g.tree_id = df.tree_id), x AS (SELECT 'all' AS topology, * FROM s UNION ALL SELECT CASE WHEN rf = 0 THEN 'exact' ELSE 'wrong' END, * FROM s) SELECT topology, count(*) AS n, {r('avg(inferred)', 'inferred')}, {r('avg(rerooted)', 'rerooted')}, {r('avg(\"true\")', '\"true\"')}, CASE WHEN avg(inferred) - avg(\"true\") > 1e-9 THEN {r('(avg(inferred) - avg(rerooted)) / (avg(inferred) - avg(\"true\"))', 'closed').rsplit(' AS ', 1)[0]} END AS closed FROM x GROUP BY topology")
def _(v):
    rows = O.split_distances(v.v_deep_named_priced, v.v_deep_named).join(scores(v), "tree_id")
    return rounded(B.three_way(rows))


HEIGHTS = f"{N}, h AS MATERIALIZED (SELECT n.tree_id, n.lo, n.parent_lo, n.is_leaf, n.dist, max(t.depth) - n.depth AS height FROM n JOIN n t ON t.tree_id = n.tree_id AND t.is_leaf AND t.lo BETWEEN n.lo AND n.hi GROUP BY n.tree_id, n.lo, n.parent_lo, n.is_leaf, n.dist, n.depth), p AS MATERIALIZED (SELECT h.*, CASE WHEN h.is_leaf THEN 1000 ELSE 1000.0 * (top.height - h.height) / top.height END AS place, top.height AS top FROM h JOIN h top ON top.tree_id = h.tree_id AND top.parent_lo IS NULL)"


@query("t5_ultrametric_lengths", f"WITH {HEIGHTS} SELECT c.tree_id, c.lo, {r('CASE WHEN c.top = 0 THEN c.dist WHEN c.parent_lo IS NOT NULL THEN c.place - u.place END', 'dist')} FROM p c LEFT JOIN p u ON u.tree_id = c.tree_id AND u.lo = c.parent_lo")
def _(v):
    return rounded(O.ultrametric_lengths(v.v_deep, 1000.0).select("tree_id", "lo", "dist"))
