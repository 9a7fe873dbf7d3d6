"""Tree, network and comparison queries over trees of any depth: the first leaf order as the truth, the order by price as the inferred tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import networks as N
from ..operators import trees as T
from ..operators.lineage import cut
from ..registry import query
from .summary_queries import r, rounded

#: Levels that the SQL spells out; the queries follow the data.
LEVELS = 40


def _codes(view: str, p: str = "") -> str:
    """SQL tables ``{p}n`` (nodes) and ``{p}codes``: each level's codes from the level below."""
    tip = lambda d: f"SELECT tree_id, parent_lo, lo, label AS code FROM {p}n WHERE is_leaf AND depth = {d}"
    out = [f"{p}n AS MATERIALIZED (SELECT tree_id, lo, hi, depth, parent_lo, is_leaf, label, dist FROM {view})", f"{p}c{LEVELS} AS MATERIALIZED ({tip(LEVELS)})"]
    for d in range(LEVELS - 1, -1, -1):
        out.append(f"{p}c{d} AS MATERIALIZED ({tip(d)} UNION ALL SELECT u.tree_id, u.parent_lo, u.lo, concat('(', string_agg(c.code, ',' ORDER BY c.code), ')') FROM {p}n u JOIN {p}c{d + 1} c ON c.tree_id = u.tree_id AND c.parent_lo = u.lo GROUP BY u.tree_id, u.parent_lo, u.lo)")
    return ", ".join([*out, f"{p}codes AS MATERIALIZED ({' UNION ALL '.join(f'SELECT tree_id, parent_lo, lo, code FROM {p}c{d}' for d in range(LEVELS + 1))})"])


def _live(view: str, p: str = "") -> str:
    """Adds ``{p}live`` and ``{p}rets``: groups of like subtrees from the root down, the first copy staying."""
    return f"""{_codes(view, p)},
{p}f AS MATERIALIZED (SELECT n.*, c.code, min(n.lo) OVER (PARTITION BY n.tree_id, c.code) AS kept FROM {p}n n JOIN {p}codes c ON c.tree_id = n.tree_id AND c.lo = n.lo),
{p}met AS MATERIALIZED (SELECT * FROM {p}f x WHERE NOT EXISTS (SELECT 1 FROM {p}f u WHERE u.tree_id = x.tree_id AND u.lo <> u.kept AND u.lo < x.lo AND u.hi >= x.hi)),
{p}groups AS MATERIALIZED (SELECT tree_id, kept, count(*) AS k, count(DISTINCT parent_lo) AS d FROM {p}met GROUP BY tree_id, kept),
{p}live AS MATERIALIZED (SELECT m.*, g.k, g.d FROM {p}met m JOIN {p}groups g ON g.tree_id = m.tree_id AND g.kept = m.kept),
{p}rets AS MATERIALIZED (SELECT l.tree_id, l.lo AS ret_id, l.hi AS last, l.k, l.d, (SELECT max(t.depth) FROM {p}n t WHERE t.is_leaf AND t.tree_id = l.tree_id AND t.lo BETWEEN l.lo AND l.hi) - l.depth AS height FROM {p}live l WHERE l.k > 1 AND l.lo = l.kept)"""


def _sets(p: str = "") -> str:
    """Adds ``{p}leaves`` (species below reticulations), ``{p}sides`` (their parents), ``{p}sis`` (species beside them)."""
    return f"""{p}leaves AS MATERIALIZED (SELECT DISTINCT x.tree_id, x.ret_id, t.label AS species FROM {p}rets x JOIN {p}n t ON t.tree_id = x.tree_id AND t.is_leaf AND t.lo BETWEEN x.ret_id AND x.last),
{p}sides AS MATERIALIZED (SELECT DISTINCT tree_id, kept AS ret_id, parent_lo AS side FROM {p}live WHERE k > 1),
{p}sis AS MATERIALIZED (SELECT DISTINCT s.tree_id, s.ret_id, s.side, t.label AS species FROM {p}sides s JOIN {p}live b ON b.tree_id = s.tree_id AND b.parent_lo = s.side AND b.kept <> s.ret_id JOIN {p}n t ON t.tree_id = s.tree_id AND t.is_leaf AND t.lo BETWEEN b.lo AND b.hi)"""


def _network(p: str = "", rounds: int = 8) -> str:
    """Adds ``{p}e`` (edges without nodes of one way in and out), ``{p}class`` and ``{p}mu``."""
    out = [f"{p}e0 AS MATERIALIZED (SELECT DISTINCT tree_id, parent_lo AS parent, CASE WHEN k > 1 THEN -kept - 1 ELSE lo END AS child FROM {p}live WHERE parent_lo IS NOT NULL UNION SELECT tree_id, -kept - 1, kept FROM {p}live WHERE k > 1)"]
    for i in range(rounds):
        out.append(f"{p}idle{i} AS MATERIALIZED (SELECT a.tree_id, a.node FROM (SELECT tree_id, child AS node FROM {p}e{i} GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT tree_id, parent AS node FROM {p}e{i} GROUP BY ALL HAVING count(*) = 1) b ON a.tree_id = b.tree_id AND a.node = b.node)")
        out.append(f"{p}w{i} AS (SELECT e.tree_id, e.parent, e.child FROM {p}e{i} e WHERE NOT EXISTS (SELECT 1 FROM {p}idle{i} x WHERE x.tree_id = e.tree_id AND x.node = e.parent) UNION ALL SELECT w.tree_id, w.parent, e.child FROM {p}w{i} w JOIN {p}idle{i} x ON x.tree_id = w.tree_id AND x.node = w.child JOIN {p}e{i} e ON e.tree_id = w.tree_id AND e.parent = w.child)")
        out.append(f"{p}e{i + 1} AS MATERIALIZED (SELECT DISTINCT w.tree_id, w.parent, w.child FROM {p}w{i} w WHERE NOT EXISTS (SELECT 1 FROM {p}idle{i} x WHERE x.tree_id = w.tree_id AND x.node = w.child))")
    out.append(f"""{p}e AS (SELECT * FROM {p}e{rounds}),
{p}nodes AS MATERIALIZED (SELECT tree_id, parent AS node FROM {p}e UNION SELECT tree_id, child FROM {p}e UNION SELECT tree_id, lo FROM {p}n WHERE is_leaf AND tree_id NOT IN (SELECT tree_id FROM {p}e)),
{p}deg AS MATERIALIZED (SELECT x.tree_id, x.node, (SELECT count(*) FROM {p}e e WHERE e.tree_id = x.tree_id AND e.child = x.node) AS ins, (SELECT count(*) FROM {p}e e WHERE e.tree_id = x.tree_id AND e.parent = x.node) AS outs FROM {p}nodes x),
{p}stack AS (SELECT e.tree_id, count(*) AS stacked FROM {p}e e JOIN {p}deg a ON a.tree_id = e.tree_id AND a.node = e.parent AND a.ins > 1 JOIN {p}deg b ON b.tree_id = e.tree_id AND b.node = e.child AND b.ins > 1 GROUP BY e.tree_id),
{p}class AS MATERIALIZED (SELECT d.tree_id, coalesce(max(s.stacked), 0) AS stacked, count(CASE WHEN outs = 0 AND ins <> 1 OR outs > 0 AND ins > 1 AND outs <> 1 OR outs > 0 AND ins <= 1 AND outs <> 2 THEN 1 END) AS offending FROM {p}deg d LEFT JOIN {p}stack s ON s.tree_id = d.tree_id GROUP BY d.tree_id),
{p}walk AS (SELECT tree_id, node AS top, node FROM {p}nodes UNION ALL SELECT w.tree_id, w.top, e.child FROM {p}walk w JOIN {p}e e ON e.tree_id = w.tree_id AND e.parent = w.node),
{p}mu AS MATERIALIZED (SELECT v.tree_id, v.node, max(d.ins) AS in_degree, string_agg(concat(v.species, ':', v.paths), ',' ORDER BY concat(v.species, ':', v.paths)) AS vector FROM (SELECT w.tree_id, w.top AS node, t.label AS species, count(*) AS paths FROM {p}walk w JOIN {p}n t ON t.is_leaf AND t.tree_id = w.tree_id AND t.lo = w.node GROUP BY ALL) v JOIN {p}deg d ON d.tree_id = v.tree_id AND d.node = v.node GROUP BY v.tree_id, v.node)""")
    return ", ".join(out)


def greedy(name: str, left: str, right: str, keys: str = "tree_id") -> str:
    """SQL tables ``{name}_m``: pairs of ``left`` and ``right`` (keys, ret_id, species), the best of all first, then the best of what is left."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    of = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    size = lambda t, x: f"SELECT {keys}, ret_id AS {x}, count(*) AS n_{x} FROM {t} GROUP BY {keys}, ret_id"
    return f"""{name}_p AS MATERIALIZED (SELECT s.*, n_a, n_b, shared / (n_a + n_b - shared) AS score FROM (SELECT {of("x")}, x.ret_id AS a_, y.ret_id AS b_, count(*) AS shared FROM {left} x JOIN {right} y ON {on("x", "y")} AND x.species = y.species GROUP BY ALL) s JOIN ({size(left, "a_").replace("n_a_", "n_a")}) u ON {on("u", "s")} AND u.a_ = s.a_ JOIN ({size(right, "b_").replace("n_b_", "n_b")}) w ON {on("w", "s")} AND w.b_ = s.b_),
{name}_o AS MATERIALIZED (SELECT {keys}, list(a_ ORDER BY score DESC, a_, b_) AS xs, list(b_ ORDER BY score DESC, a_, b_) AS ys FROM {name}_p GROUP BY {keys}),
{name}_r AS (SELECT {keys}, xs, ys, 0 AS i, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub FROM {name}_o UNION ALL SELECT {keys}, xs, ys, i + 1, CASE WHEN list_contains(ua, xs[i + 1]) OR list_contains(ub, ys[i + 1]) THEN ua ELSE list_append(ua, xs[i + 1]) END, CASE WHEN list_contains(ua, xs[i + 1]) OR list_contains(ub, ys[i + 1]) THEN ub ELSE list_append(ub, ys[i + 1]) END FROM {name}_r WHERE i < len(xs)),
{name}_m AS MATERIALIZED (SELECT {of("p")}, p.a_ AS a, p.b_ AS b, p.shared, p.n_a, p.n_b FROM {name}_p p JOIN {name}_r f ON {on("p", "f")} AND f.i = len(f.xs) AND list_position(f.ua, p.a_) > 0 AND list_position(f.ua, p.a_) = list_position(f.ub, p.b_))"""


def completed(name: str, left: str, right: str, keys: str = "tree_id") -> str:
    """Adds ``{name}_all``: the matches and what is left on both sides (``left``, ``right``: keys, ret_id, n) in order."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    of = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    rest = lambda t, x: f"SELECT {of('z')}, z.ret_id, z.n, row_number() OVER (PARTITION BY {of('z')} ORDER BY z.ret_id) AS rank FROM {t} z WHERE NOT EXISTS (SELECT 1 FROM {name}_m m WHERE {on('m', 'z')} AND m.{x} = z.ret_id)"
    return f"{name}_all AS MATERIALIZED (SELECT {keys}, a, b, shared, n_a, n_b FROM {name}_m UNION ALL SELECT {of('x')}, x.ret_id, y.ret_id, 0, x.n, y.n FROM ({rest(left, 'a')}) x JOIN ({rest(right, 'b')}) y ON {on('x', 'y')} AND x.rank = y.rank)"


PAIR_SUMS = "sum(coalesce((n_a + n_b - 2 * shared) / nullif(n_a + n_b - shared, 0), 0)) AS dist, sum(coalesce((n_b - shared) / nullif(n_b, 0), 0)) AS fp, sum(coalesce((n_a - shared) / nullif(n_a, 0), 0)) AS fn"


def normalised(sums: str, left: str, right: str, keys: str = "tree_id") -> str:
    """SELECT of the penalised and matched forms from sums per key."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    both = f"SELECT {', '.join(f'coalesce(x.{k}, y.{k}) AS {k}' for k in keys.split(', '))}, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM (SELECT {keys}, count(*) AS l FROM {left} GROUP BY {keys}) x FULL JOIN (SELECT {keys}, count(*) AS r FROM {right} GROUP BY {keys}) y ON {on('x', 'y')}"
    pick = lambda when_l, when_r, x: f"CASE WHEN l = 0 THEN {when_l} WHEN r = 0 THEN {when_r} ELSE {x} END"
    s = lambda c: f"coalesce(s.{c}, 0)"
    dist, matched = f"({s('dist')} + greatest(l, r) - least(l, r)) / greatest(l, r)", f"{s('dist')} / least(l, r)"
    return f"""SELECT {', '.join(f'c.{k}' for k in keys.split(', '))}, {pick('1.0', '1.0', dist)} AS dist, {pick('1.0', '0.0', f"({s('fp')} + greatest(l, r) - l) / greatest(l, r)")} AS fp, {pick('0.0', '1.0', f"({s('fn')} + greatest(l, r) - r) / greatest(l, r)")} AS fn, {pick('0.0', '0.0', f'1 - {dist}')} AS tp,
{pick('1.0', '1.0', matched)} AS dist_matched, {pick('1.0', '0.0', f"{s('fp')} / least(l, r)")} AS fp_matched, {pick('0.0', '1.0', f"{s('fn')} / least(l, r)")} AS fn_matched, {pick('0.0', '0.0', f'1 - {matched}')} AS tp_matched
FROM ({both}) c LEFT JOIN ({sums}) s ON {on('s', 'c')}"""


FORMS = ("dist", "fp", "fn", "tp", "dist_matched", "fp_matched", "fn_matched", "tp_matched")
ROUNDED = ", ".join(r(c, c) for c in FORMS)


def leaf_distance(left: str, right: str, match: str = "lm") -> str:
    """SQL tables from ``left`` and ``right`` (tree_id, ret_id, species) to ``leaf_dist``."""
    size = lambda t: f"SELECT tree_id, ret_id, count(*) AS n FROM {t} GROUP BY tree_id, ret_id"
    return f"""{match}_ls AS MATERIALIZED ({size(left)}), {match}_rs AS MATERIALIZED ({size(right)}), {greedy(match, left, right)}, {completed(match, f'{match}_ls', f'{match}_rs')},
leaf_dist AS MATERIALIZED ({normalised(f'SELECT tree_id, {PAIR_SUMS} FROM {match}_all GROUP BY tree_id', f'{match}_ls', f'{match}_rs')})"""


def sister_distance(match: str = "lm") -> str:
    """Adds ``sister_dist`` from the matched reticulations and the tables of `_sets` of both sides (t, q)."""
    keys = "tree_id, ra, rb"
    side = lambda p, x: f"SELECT m.tree_id, m.a AS ra, m.b AS rb, s.side AS ret_id, coalesce(z.species, '') AS species FROM {match}_all m JOIN {p}sides s ON s.tree_id = m.tree_id AND s.ret_id = m.{x} LEFT JOIN {p}sis z ON z.tree_id = s.tree_id AND z.ret_id = s.ret_id AND z.side = s.side"
    size = lambda t: f"SELECT {keys}, ret_id, count(CASE WHEN species <> '' THEN 1 END) AS n FROM {t} GROUP BY {keys}, ret_id"
    return f"""sx AS MATERIALIZED ({side('t', 'a')}), sy AS MATERIALIZED ({side('q', 'b')}), sxn AS MATERIALIZED ({size('sx')}), syn AS MATERIALIZED ({size('sy')}),
{greedy('sm', 'sx', 'sy', keys)}, {completed('sm', 'sxn', 'syn', keys)},
inner_dist AS MATERIALIZED ({normalised(f'SELECT {keys}, {PAIR_SUMS} FROM sm_all GROUP BY {keys}', 'sxn', 'syn', keys)}),
sister_dist AS MATERIALIZED ({normalised('SELECT tree_id, sum(dist) AS dist, sum(fp) AS fp, sum(fn) AS fn FROM inner_dist GROUP BY tree_id', f'{match}_ls', f'{match}_rs')})"""


@query("t2_depth_height_deep", "WITH n AS (SELECT * FROM v_deep) SELECT n.tree_id, n.lo, n.depth, CAST(max(t.depth) - n.depth AS INT) AS height FROM n JOIN n t ON t.tree_id = n.tree_id AND t.is_leaf AND t.lo BETWEEN n.lo AND n.hi GROUP BY n.tree_id, n.lo, n.depth")
def _(v):
    return T.with_height(v.v_deep).select("tree_id", "lo", "depth", "height")


@query("t6_canonical_classes", f"WITH {_codes('v_deep')} SELECT tree_id, lo, first_value(tree_id * 100000 + lo) OVER (PARTITION BY code ORDER BY tree_id, lo) AS kind FROM codes")
def _(v):
    """Every node with the first node of the whole table that it is alike to."""
    codes = cut(T.canonical_codes(v.v_deep).select("tree_id", "lo", "code"), "codes")
    first = codes.groupBy("code").agg(F.min(F.struct("tree_id", "lo")).alias("f")).select("code", (F.col("f.tree_id") * 100000 + F.col("f.lo")).alias("kind"))
    return codes.join(first, "code").select("tree_id", "lo", "kind")


@query("t16_collapse_identical_deep", f"WITH {_codes('v_deep')} SELECT min(tree_id) AS tree_id, count(*) AS n_trees FROM codes WHERE parent_lo IS NULL GROUP BY code")
def _(v):
    return T.collapse_identical(v.v_deep)


@query("n1_fold_deep", f"WITH {_live('v_deep')} SELECT tree_id, ret_id, last, k, d, height, k - d AS auto_events, d - 1 AS allo_events, CASE WHEN d > 1 THEN 1 ELSE 0 END AS allo_group FROM rets")
def _(v):
    return N.fold(cut(v.v_deep, "nodes"))


@query("n4_sister_sets", f"WITH {_live('v_deep')}, {_sets()} SELECT s.tree_id, s.ret_id, s.side, coalesce(string_agg(z.species, ',' ORDER BY z.species), '') AS sisters FROM sides s LEFT JOIN sis z ON z.tree_id = s.tree_id AND z.ret_id = s.ret_id AND z.side = s.side GROUP BY s.tree_id, s.ret_id, s.side")
def _(v):
    nodes = cut(v.v_deep, "nodes")
    return N.sister_sets(nodes, N.live_nodes(nodes)).withColumn("sisters", F.array_join("sisters", ","))


@query("n6_mu_vectors", f"WITH RECURSIVE {_live('v_deep')}, {_network()} SELECT tree_id, node, in_degree, vector FROM mu")
def _(v):
    return N.mu_vectors(v.v_deep)


@query("n7_network_class", f"WITH RECURSIVE {_live('v_deep')}, {_network()} SELECT tree_id, stacked, offending, stacked = 0 AND offending = 0 AS in_class FROM class")
def _(v):
    nodes = cut(v.v_deep, "nodes")
    return N.network_class(nodes, N.suppressed(N.network_edges(N.live_nodes(nodes)))).drop("taxa")


SIDES = f"{_live('v_deep', 't')}, {_sets('t')}, {_network('t')}, {_live('v_deep_priced', 'q')}, {_sets('q')}, {_network('q')}"
MU = """taxa AS (SELECT tree_id, string_agg(DISTINCT label, ',' ORDER BY label) AS x FROM tn WHERE is_leaf GROUP BY tree_id), qtaxa AS (SELECT tree_id, string_agg(DISTINCT label, ',' ORDER BY label) AS x FROM qn WHERE is_leaf GROUP BY tree_id),
alone AS (SELECT tree_id, count(*) AS total, count(CASE WHEN lacks THEN 1 END) AS alone FROM (SELECT t.tree_id, NOT EXISTS (SELECT 1 FROM qmu i WHERE i.tree_id = t.tree_id AND i.in_degree = t.in_degree AND i.vector = t.vector) AS lacks FROM tmu t UNION ALL SELECT i.tree_id, NOT EXISTS (SELECT 1 FROM tmu t WHERE i.tree_id = t.tree_id AND i.in_degree = t.in_degree AND i.vector = t.vector) FROM qmu i) q GROUP BY tree_id),
mu_dist AS MATERIALIZED (SELECT a.tree_id, CASE WHEN ok THEN alone / total END AS mu_distance, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS mu_scored FROM (SELECT a.tree_id, a.stacked = 0 AND a.offending = 0 AND b.stacked = 0 AND b.offending = 0 AND ta.x = tb.x AS ok FROM tclass a JOIN qclass b ON a.tree_id = b.tree_id JOIN taxa ta ON ta.tree_id = a.tree_id JOIN qtaxa tb ON tb.tree_id = a.tree_id) a JOIN alone z ON z.tree_id = a.tree_id)"""


@query("n8_mu_distance", f"WITH RECURSIVE {SIDES}, {MU} SELECT tree_id, {r('mu_distance', 'mu_distance')}, CAST(mu_scored AS DOUBLE) AS mu_scored FROM mu_dist")
def _(v):
    return rounded(N.mu_distances(v.v_deep, v.v_deep_priced))


@query("n9_duplicated_siblings_deep", f"WITH {_codes('v_deep')}, g AS (SELECT tree_id, parent_lo, code, count(*) AS k FROM codes WHERE parent_lo IS NOT NULL GROUP BY ALL HAVING count(*) > 1), m AS (SELECT n.tree_id, n.lo, n.hi FROM g JOIN codes c ON c.tree_id = g.tree_id AND c.parent_lo = g.parent_lo AND c.code = g.code JOIN n ON n.tree_id = c.tree_id AND n.lo = c.lo) SELECT tree_id, count(*) AS groups, CAST(sum(k - 1) AS BIGINT) AS events FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree_id = g.tree_id AND g.parent_lo BETWEEN m.lo AND m.hi) GROUP BY tree_id")
def _(v):
    return N.duplicated_siblings(v.v_deep)


def _reticulated(v):
    out = []
    for d in (cut(v.v_deep, "nodes"), cut(v.v_deep_priced, "nodes")):
        live = N.live_nodes(d)
        out.append((cut(N.reticulation_leaves(d, N.reticulations(d, live)), "ret_leaves"), N.sister_sets(d, live)))
    return out


RETS = f"{_live('v_deep', 't')}, {_sets('t')}, {_live('v_deep_priced', 'q')}, {_sets('q')}, {leaf_distance('tleaves', 'qleaves')}"


@query("c4_leaf_set_distance_deep", f"WITH RECURSIVE {RETS} SELECT tree_id, {ROUNDED} FROM leaf_dist")
def _(v):
    (left, _), (right, _) = _reticulated(v)
    return rounded(N.leaf_set_distance(N.match_reticulations(left, right), left, right))


@query("c5_sister_set_distance", f"WITH RECURSIVE {RETS}, {sister_distance()} SELECT tree_id, {ROUNDED} FROM sister_dist")
def _(v):
    return rounded(N.sister_set_distances(v.v_deep, v.v_deep_priced))


COUNTS = 'counts AS MATERIALIZED (SELECT coalesce(a.tree_id, b.tree_id) AS tree_id, coalesce(a.n, 0) AS t, coalesce(b.n, 0) AS i FROM (SELECT tree_id, label, count(*) AS n FROM tn WHERE is_leaf GROUP BY ALL) a FULL JOIN (SELECT tree_id, label, count(*) AS n FROM qn WHERE is_leaf GROUP BY ALL) b ON a.tree_id = b.tree_id AND a.label = b.label)'


def _c6() -> str:
    single = "k.method = 'grampa'"
    form = lambda t, c: f"CASE WHEN {single} THEN {t}.{c}_matched ELSE {t}.{c} END"
    rows = [("num_rets_diff", "abs(coalesce(ir.n, 0) - coalesce(tr.n, 0))"), ("num_rets_bias", "coalesce(ir.n, 0) - coalesce(tr.n, 0)"), ("polyploid_species_jaccard", "pj.dist"), ("mu_distance", "mu.mu_distance"), ("mu_scored", "mu.mu_scored")]
    rows += [(f"ploidy_diff.{x}", f"pd.{c}") for x, c in (("dist", "dist"), ("FP", "fp"), ("FN", "fn"), ("TP", "tp"))]
    for name, t in (("ret_leaf_jaccard", "ld"), ("ret_sisters_jaccard", "sd")):
        rows += [(f"{name}.{x}", f"coalesce({form(t, c)}, 0)") for x, c in (("dist", "dist"), ("FP", "fp"), ("FN", "fn"), ("TP", "tp"))]
        rows += [(f"{name}_matched.{x}", f"coalesce({t}.{c}_matched, 0)") for x, c in (("dist", "dist"), ("FP", "fp"), ("FN", "fn"), ("TP", "tp"))]
    values = ", ".join(f"struct_pack(metric := '{m}', value := CAST({x} AS DOUBLE))" for m, x in rows)
    events = lambda p: f"(SELECT tree_id, sum(k - 1) AS n FROM {p}rets GROUP BY tree_id)"
    return f"""WITH RECURSIVE {SIDES}, {leaf_distance('tleaves', 'qleaves')}, {sister_distance()}, {MU}, {COUNTS},
pd AS (SELECT tree_id, CASE WHEN u = 0 THEN 0.0 ELSE 1 - tp / u END AS dist, tp, fp, fn FROM (SELECT tree_id, coalesce(sum(CASE WHEN t <> 1 OR i <> 1 THEN least(t, i) - 1 END), 0) AS tp, sum(greatest(i - t, 0)) AS fp, sum(greatest(t - i, 0)) AS fn, coalesce(sum(CASE WHEN t <> 1 OR i <> 1 THEN greatest(t, i) - 1 END), 0) AS u FROM counts GROUP BY tree_id) q),
pj AS (SELECT tree_id, CASE WHEN u = 0 THEN 0.0 ELSE 1 - k / u END AS dist FROM (SELECT tree_id, count(CASE WHEN t > 1 AND i > 1 THEN 1 END) AS k, count(CASE WHEN t > 1 OR i > 1 THEN 1 END) AS u FROM counts GROUP BY tree_id) q),
keys AS (SELECT DISTINCT tree_id, tree_id % 25 AS network, tree_id % 3 AS config, CASE tree_id % 5 WHEN 0 THEN 'grampa' WHEN 1 THEN 'padre' ELSE 'polyphest' END AS method, tree_id AS replicate, tree_id % 7 = 0 AS lost FROM tn)
SELECT network, config, method, replicate, m.metric, round(m.value, 6) AS value, CASE WHEN method = 'grampa' THEN 'partial' ELSE 'standard' END AS jaccard_mode, 'SUCCESS' AS status
FROM (SELECT k.network, k.config, k.method, k.replicate, unnest([{values}]) AS m FROM keys k LEFT JOIN {events('t')} tr ON tr.tree_id = k.tree_id LEFT JOIN {events('q')} ir ON ir.tree_id = k.tree_id LEFT JOIN pd ON pd.tree_id = k.tree_id LEFT JOIN pj ON pj.tree_id = k.tree_id LEFT JOIN mu_dist mu ON mu.tree_id = k.tree_id LEFT JOIN leaf_dist ld ON ld.tree_id = k.tree_id LEFT JOIN sister_dist sd ON sd.tree_id = k.tree_id WHERE NOT k.lost) q
UNION ALL SELECT network, config, method, replicate, 'FAILED', NULL, NULL, 'FAILED' FROM keys WHERE lost"""


@query("c6_compare_networks", _c6())
def _(v):
    """Every order's tree against the one in order of price; each seventh has no inferred tree."""
    tree = F.col("tree_id")
    method = F.when(tree % 5 == 0, "grampa").when(tree % 5 == 1, "padre").otherwise("polyphest")
    pairs = v.v_leaves.select("tree_id").distinct().select((tree % 25).alias("network"), (tree % 3).alias("config"), method.alias("method"), tree.alias("replicate"), tree.alias("truth_id"), F.when(tree % 7 != 0, tree).alias("inferred_id"))
    return rounded(N.compare_networks(v.v_deep, v.v_deep_priced, pairs))
