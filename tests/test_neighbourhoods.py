"""Neighbourhoods of copies against the definition, and their support without a shuffle beside that of trees."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_networks import random_tree, text_of

from cladeframe.operators import topology as Y
from cladeframe.operators import trees as T


def around(tree, most):
    """(species, neighbours) of each copy of a repeated label, from nested tuples."""
    paths = []

    def walk(t, above):
        if isinstance(t, str):
            paths.append((t, above))
            return [t]
        me = []
        for c in t:
            me += walk(c, [*above, me])
        return me

    walk(tree, [])
    n, out = Counter(x for x, _ in paths), []
    for x, above in paths:
        if n[x] > 1 and above:
            near = Counter(next((a for a in above if a is above[-1] or len(a) <= most)))
            near[x] -= 1
            out.append((x, sorted((k, v) for k, v in near.items() if v)))
    return sorted(out)


def test_neighbourhoods_and_their_support(spark):
    rng = random.Random(8)
    trees = [random_tree(rng, n) for n in [1, 2, 3, 4, 5, 6, 8, 11, 14] * 5]
    nodes = T.parse_newick(spark.createDataFrame([(i, text_of(t) + ";") for i, t in enumerate(trees)], "tree_id long, newick string")).persist()
    for most in (1, 4, 10):
        found = {}
        for r in Y.copy_neighbourhoods(nodes, most).collect():
            found.setdefault((r.tree_id, r.leaf, r.species), []).append((r.other, r.n))
        assert sorted((t, s, sorted(v)) for (t, _, s), v in found.items()) == [(i, *x) for i, t in enumerate(trees) for x in around(t, most)]
    members = [("x", "a"), ("x", "b"), ("y", "c"), ("z", "a"), ("z", "c"), ("z", "d")]
    clades = spark.createDataFrame(members, "clade string, species string")
    samples = spark.createDataFrame([(0, len(trees))], "sample_id int, trees long")
    want = {}
    for t in trees:
        for s, near in around(t, 4):
            share = {c: sum(v for k, v in near if (c, k) in members) / sum(v for _, v in near) for c in "xyz"}
            for c in "xyz":
                if (c, s) in members and share[c] < 0.5:
                    for o in "xyz":
                        if share[o]:
                            want.setdefault((c, o), []).append(share[o])
    got = Y.copy_cluster_support(Y.copy_neighbourhoods(nodes, 4).withColumn("sample_id", F.lit(0)), clades, samples).collect()
    assert sorted((r.clade, r.other, round(r.total, 9), round(r.peak, 9)) for r in got) == sorted((*k, round(sum(v) / len(trees), 9), round(max(v), 9)) for k, v in want.items())


def test_neighbourhoods_move_no_nodes(spark):
    nodes = T.parse_newick(spark.createDataFrame([(1, "(a,(a,b));")], "tree_id long, newick string"))
    by_tree = spark.createDataFrame(nodes.collect(), nodes.schema).repartition(5, "tree_id")
    clades = F.broadcast(spark.createDataFrame([("x", "a")], "clade string, species string"))
    samples = F.broadcast(spark.createDataFrame([(0, 1)], "sample_id int, trees long"))
    plan = Y.copy_cluster_support(Y.copy_neighbourhoods(by_tree, 4).withColumn("sample_id", F.lit(0)), clades, samples)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 2  # trees, and sums by sample and clades
