"""Views of the driver tables as a tree corpus: an order is a tree, its items are leaves, nations are species.

Each view is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")

#: Trees of any depth over ``LEAVES``: two of three halve the leaves again and again, the third splits off one leaf at a time.
DEEP = """
        WITH l AS (SELECT tree_id, sample_id, clade, dist, pos, count(*) OVER (PARTITION BY tree_id) AS n FROM LEAVES),
             p AS (SELECT * FROM (VALUES (1, 2), (2, 4), (3, 8), (4, 16), (5, 32), (6, 64)) t(j, wide)),
             s AS (SELECT tree_id, sample_id, pos * 64 + 63 AS lo, pos * 64 + 63 AS hi, TRUE AS is_leaf, clade AS label, CAST(dist AS DOUBLE) AS dist FROM l
                   UNION ALL
                   SELECT tree_id, sample_id, pos * 64 + 6 - j, (least(n, pos + wide) - 1) * 64 + 63, FALSE, NULL, 1.0 FROM l JOIN p ON pos % wide = 0 AND pos + wide / 2 < n WHERE tree_id % 3 <> 0
                   UNION ALL
                   SELECT tree_id, sample_id, -1, (n - 1) * 64 + 63, FALSE, NULL, 1.0 FROM l WHERE tree_id % 3 <> 0 AND n > 64 AND pos = 0
                   UNION ALL
                   SELECT tree_id, sample_id, pos * 64, (n - 1) * 64 + 63, FALSE, NULL, 1.0 FROM l WHERE tree_id % 3 = 0 AND pos < n - 1)
        SELECT s.tree_id, s.sample_id, s.lo, s.hi, CAST(count(u.lo) AS INT) AS depth, max(u.lo) AS parent_lo, s.is_leaf, s.label, s.dist
        FROM s LEFT JOIN s u ON u.tree_id = s.tree_id AND NOT u.is_leaf AND u.lo < s.lo AND u.hi >= s.hi
        GROUP BY s.tree_id, s.sample_id, s.lo, s.hi, s.is_leaf, s.label, s.dist"""

VIEWS = {
    "v_leaves": """
        SELECT l_orderkey AS tree_id, o_custkey % 21 AS sample_id, n_name AS species, r_name AS clade, l_quantity AS dist,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS pos
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey
             JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_nodes": """
        SELECT tree_id, sample_id, lo, hi, depth, parent_lo, is_leaf, label, dist FROM (
            SELECT tree_id, sample_id, 0 AS lo, max(pos) + CAST(floor(max(pos) / 2.0) AS BIGINT) + 1 + 1 AS hi, 0 AS depth, CAST(NULL AS BIGINT) AS parent_lo, FALSE AS is_leaf, CAST(NULL AS STRING) AS label, 0.0 AS dist
            FROM {v_leaves} GROUP BY tree_id, sample_id
            UNION ALL
            SELECT tree_id, sample_id, 1 + CAST(floor(pos / 2.0) AS BIGINT) * 3, 1 + CAST(floor(pos / 2.0) AS BIGINT) * 3 + count(*), 1, 0, FALSE, NULL, 1.0
            FROM {v_leaves} GROUP BY tree_id, sample_id, CAST(floor(pos / 2.0) AS BIGINT)
            UNION ALL
            SELECT tree_id, sample_id, 2 + CAST(floor(pos / 2.0) AS BIGINT) * 3 + pos % 2, 2 + CAST(floor(pos / 2.0) AS BIGINT) * 3 + pos % 2, 2, 1 + CAST(floor(pos / 2.0) AS BIGINT) * 3, TRUE, species, dist
            FROM {v_leaves}) n""",
    "v_mul": "SELECT tree_id, pos, clade AS species, CAST(floor(pos / 2.0) AS BIGINT) AS k, 2 + CAST(floor(pos / 2.0) AS BIGINT) * 3 + pos % 2 AS lo FROM {v_leaves}",
    "v_truth_copies": "SELECT tree_id, clade AS species, count(*) AS n FROM {v_leaves} GROUP BY tree_id, clade",
    "v_inferred_copies": "SELECT tree_id, clade AS species, count(*) AS n FROM {v_leaves} WHERE dist > 10 GROUP BY tree_id, clade",
    "v_newick": """
        SELECT tree_id, sample_id, concat('(', string_agg(pair, ',' ORDER BY k), ');') AS newick FROM (
            SELECT tree_id, sample_id, CAST(floor(pos / 2.0) AS BIGINT) AS k, concat('(', string_agg(concat(species, ':', CAST(CAST(dist AS INT) AS STRING)), ',' ORDER BY pos), '):1') AS pair
            FROM {v_leaves} GROUP BY tree_id, sample_id, CAST(floor(pos / 2.0) AS BIGINT)) p
        GROUP BY tree_id, sample_id""",
    "v_priced": """
        SELECT l_orderkey AS tree_id, o_custkey % 21 AS sample_id, r_name AS clade, l_quantity AS dist,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS pos
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey
             JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_named": "SELECT tree_id, sample_id, species AS clade, dist, pos FROM {v_leaves}",
    "v_named_priced": """
        SELECT l_orderkey AS tree_id, o_custkey % 21 AS sample_id, n_name AS clade, l_quantity AS dist,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS pos
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "v_deep_named": DEEP.replace("LEAVES", "{v_named}"),
    "v_deep_named_priced": DEEP.replace("LEAVES", "{v_named_priced}"),
    "v_polyploids": "SELECT n_name AS species FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name HAVING avg(s_acctbal) < 4500",
    "v_allo_events": """
        SELECT event_ix, sample_id, species, partner FROM (
            SELECT c_custkey AS event_ix, c_custkey % 21 AS sample_id, r_name AS species, clade AS partner, row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, clade) AS k
            FROM {v_leaves} JOIN {orders} ON tree_id = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
            WHERE clade <> r_name GROUP BY c_custkey, r_name, clade) e
        WHERE k = 1""",
    "v_partner_calls": """
        SELECT sample_id, edge, partner, predicted FROM (
            SELECT e.*, row_number() OVER (PARTITION BY sample_id, edge ORDER BY c_custkey) AS k FROM (
                SELECT c_custkey, sample_id, edge, max(CASE WHEN by_lines = 1 THEN other END) AS partner, max(CASE WHEN by_price = 1 THEN other END) AS predicted FROM (
                    SELECT c_custkey, c_custkey % 21 AS sample_id, c_nationkey AS edge, s_nationkey AS other,
                           row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, s_nationkey) AS by_lines,
                           row_number() OVER (PARTITION BY c_custkey ORDER BY max(l_extendedprice) DESC, s_nationkey) AS by_price
                    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
                    GROUP BY c_custkey, c_nationkey, s_nationkey) g
                GROUP BY c_custkey, sample_id, edge) e) f
        WHERE k = 1""",
    "v_training": """
        SELECT o_custkey AS sample, count(DISTINCT species) AS n_species, count(*) AS n_leaves, count(DISTINCT tree_id) AS requested, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN tree_id END) AS applied
        FROM {v_leaves} JOIN {orders} ON tree_id = o_orderkey GROUP BY o_custkey""",
    "v_deep": DEEP.replace("LEAVES", "{v_leaves}"),
    "v_deep_priced": DEEP.replace("LEAVES", "{v_priced}"),
    "v_truth_events": """
        SELECT c_custkey AS event_ix, c_custkey % 21 AS sample_id, CASE WHEN c_acctbal < 0 THEN 'auto' ELSE 'allo' END AS event_type, n_name AS target, r_name AS target_clade, c_mktsegment = 'BUILDING' AS whole_clade, (c_nationkey + 1) % 25 AS partner_key
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_edge_scores": """
        SELECT d.source AS sample_id, d.doc_id AS edge_ix, d.lang AS config, least(d.n_chars / 5000.0, 1.0) AS prob, l.quality AS target
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_comparisons": """
        SELECT network, config, method, replicate, metric, CASE WHEN m > 150 THEN NULL ELSE m END AS value,
               CASE WHEN m > 150 THEN 'FAILED' ELSE 'SUCCESS' END AS status
        FROM (SELECT user_id % 25 AS network, user_id % 3 AS config, event_type AS method, event_id % 5 + 1 AS replicate,
                     CAST(floor(event_id / 5.0) AS BIGINT) % 4 AS metric, avg(value) AS m
              FROM {events} GROUP BY 1, 2, 3, 4, 5) c""",
    "v_network_stats": """
        SELECT n.n_nationkey AS network, count(DISTINCT s.s_suppkey) AS num_species, max(c.wgd) AS total_wgd, max(c.customers) % 7 AS h_strict, max(n.n_regionkey) + 1 AS max_copies
        FROM {nation} n LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey
             LEFT JOIN (SELECT c_nationkey, count(*) AS customers, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS wgd FROM {customer} GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey
        GROUP BY n.n_nationkey""",
    "v_inventory": """
        SELECT g.network, g.config, g.method, g.replicate, max(CASE WHEN c.network IS NULL THEN 0 ELSE 1 END) = 1 AS inferred_exists
        FROM (SELECT n_nationkey AS network, config, method, replicate FROM {nation}
              CROSS JOIN (SELECT DISTINCT user_id % 3 AS config FROM {events}) a
              CROSS JOIN (SELECT DISTINCT event_type AS method FROM {events}) b
              CROSS JOIN (SELECT DISTINCT event_id % 5 + 1 AS replicate FROM {events}) r) g
             LEFT JOIN {v_comparisons} c ON c.network = g.network AND c.config = g.config AND c.method = g.method AND c.replicate = g.replicate
        GROUP BY 1, 2, 3, 4""",
}

#: Views of trees of any depth and the leaves they stand on. `deep_trees` makes their rows, their text is for DuckDB.
DEEP_VIEWS = {"v_deep": "v_leaves", "v_deep_priced": "v_priced", "v_deep_named": "v_named", "v_deep_named_priced": "v_named_priced"}


def deep_trees(leaves: DataFrame) -> DataFrame:
    """The rows of ``DEEP`` over ``leaves`` (``tree_id, sample_id, clade, dist, pos``) in one pass.

    Each leaf brings the inner nodes that start at its place. Which nodes lie above follows from its
    place and the tree's number of leaves, so nodes are not joined with each other.
    """
    pos, n, long = F.col("pos").cast("long"), F.col("n"), "long"
    halved = F.col("tree_id") % 3 != 0
    wide = {j: 1 << j for j in range(1, 7)}
    start = {j: pos - pos % wide[j] for j in wide}
    stands = {j: start[j] + wide[j] // 2 < n for j in wide}
    whole = n > 64

    def above(j: int) -> tuple[Column, Column]:
        """Depth and parent of what lies at this place below the halves wider than 2**j."""
        over = [k for k in wide if k > j]
        depth = sum((stands[k].cast("int") for k in over), whole.cast("int"))
        return depth, F.coalesce(*(F.when(stands[k], start[k] * 64 + 6 - k) for k in over), F.when(whole, F.lit(-1).cast(long)))

    def node(lo: Column, hi: Column, depth: Column, parent: Column, leaf: bool) -> Column:
        label, dist = (F.col("clade"), F.col("dist").cast("double")) if leaf else (F.lit(None).cast("string"), F.lit(1.0))
        return F.struct(lo.cast(long).alias("lo"), hi.cast(long).alias("hi"), depth.cast("int").alias("depth"), parent.cast(long).alias("parent_lo"), F.lit(leaf).alias("is_leaf"), label.alias("label"), dist.alias("dist"))

    tip, end, last = pos * 64 + 63, (n - 1) * 64 + 63, F.least(pos, n - 2)
    depth, parent = above(0)
    nodes = [node(tip, tip, F.when(halved, depth).otherwise(last + 1), F.when(halved, parent).when(n > 1, last * 64), True)]
    nodes += [F.when(halved & (pos % wide[j] == 0) & stands[j], node(pos * 64 + 6 - j, (F.least(n, pos + wide[j]) - 1) * 64 + 63, *above(j), False)) for j in wide]
    nodes += [F.when(halved & whole & (pos == 0), node(F.lit(-1), end, F.lit(0), F.lit(None), False)), F.when(~halved & (pos < n - 1), node(pos * 64, end, pos, F.when(pos > 0, (pos - 1) * 64), False))]
    counted = leaves.select("tree_id", "sample_id", "clade", "dist", "pos", F.count("*").over(W.partitionBy("tree_id")).alias("n"))
    return counted.select("tree_id", "sample_id", F.inline(F.array_compact(F.array(*nodes))))


def pair_trees(leaves: DataFrame, label: str = "species") -> DataFrame:
    """The rows of ``v_nodes`` over ``leaves`` (``tree_id, sample_id, dist, pos`` and ``label``) in one pass: each leaf brings the pair and the root that start at its place."""
    pos, n, long = F.col("pos").cast("long"), F.col("n"), "long"
    k = F.floor(pos / 2).cast(long)

    def node(lo: Column, hi: Column, depth: int, parent: Column, name: Column, dist: Column) -> Column:
        return F.struct(lo.cast(long).alias("lo"), hi.cast(long).alias("hi"), F.lit(depth).alias("depth"), parent.cast(long).alias("parent_lo"), F.lit(depth == 2).alias("is_leaf"), name.cast("string").alias("label"), dist.cast("double").alias("dist"))

    none, tip = F.lit(None), 2 + k * 3 + pos % 2
    nodes = [node(tip, tip, 2, 1 + k * 3, F.col(label), F.col("dist"))]
    nodes += [F.when(pos % 2 == 0, node(1 + k * 3, 1 + k * 3 + F.least(n - pos, F.lit(2)), 1, F.lit(0), none, F.lit(1.0)))]
    nodes += [F.when(pos == 0, node(F.lit(0), n + F.floor((n - 1) / 2) + 1, 0, none, none, F.lit(0.0)))]
    counted = leaves.select("tree_id", "sample_id", label, "dist", "pos", F.count("*").over(W.partitionBy("tree_id")).alias("n"))
    return counted.select("tree_id", "sample_id", F.inline(F.array_compact(F.array(*nodes))))


#: Items of a table that one task sorts and groups by tree.
ROWS_A_TASK = 250_000


def spread(items: DataFrame, key: str) -> DataFrame:
    """``items`` dealt by ``key`` into partitions of about `ROWS_A_TASK` rows; as they are if there are no more of these than cores.

    Joins, groups and windows by the same key stay in these partitions, whose number grows with the
    table, so the memory of one task does not. The session's number of partitions is fixed, and
    adaptive execution merges partitions by their shuffled bytes, which are far fewer than those of
    the sorts and hash tables over them.
    """
    parts = -(-items.count() // ROWS_A_TASK)
    return items.repartition(parts, key) if parts > items.sparkSession.sparkContext.defaultParallelism else items


class Views:
    """Tables and views of one folder as DataFrames: ``Views(spark, sf_dir).v_leaves``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in DEEP_VIEWS:
                self._known[name] = deep_trees(getattr(self, DEEP_VIEWS[name]))
            elif name == "v_nodes":
                self._known[name] = pair_trees(self.v_leaves)
            elif name == "spread_lineitem":
                self._known[name] = spread(self.lineitem, "l_orderkey")
            elif name in VIEWS:
                text = re.sub(r"string_agg\((.*?) ORDER BY (\w+)\)", r"string_agg(\1) WITHIN GROUP (ORDER BY \2)", VIEWS[name])
                if "PARTITION BY l_orderkey" in text:
                    text = text.replace("{lineitem}", "{spread_lineitem}")
                self._known[name] = self.spark.sql(text, **{x: getattr(self, x) for x in set(re.findall(r"\{(\w+)\}", text))})
            else:
                raise AttributeError(name)
        return self._known[name]


def with_views(sql: str) -> str:
    """SQL for DuckDB: the text after the definitions of the views that it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{x} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[x])})" for x in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    return f"WITH {parts},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts}\n{body}"
