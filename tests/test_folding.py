"""Networks made tree by tree inside tasks against those made for all trees at once, and against the definition."""

import random

import pytest
from pyspark.sql import functions as F
from test_networks import folded, random_tree, text_of

from cladeframe.operators import folding as P
from cladeframe.operators import networks as N
from cladeframe.operators import trees as T


def nodes_of(spark, trees):
    return T.parse_newick(spark.createDataFrame([(i, text_of(t) + ";") for i, t in enumerate(trees)], "tree_id long, newick string")).persist()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    trees = [random_tree(rng, n) for n in [1, 2, 2, 3, 4, 5, 6, 8, 8, 8, 11, 13, 16, 20] * 3]
    deep = "z"
    for i in range(60):
        deep = ("abc"[i % 3], deep)
    return [*trees, (("d", "e"), (("d", "e"), "a")), ((("b", "b"), "b"), "a"), (("a", "a"), ("a", "a")), (deep[1], (("c", ("b", "z")), "z")), deep]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_vectors_of_packed_trees(spark, corpus):
    nodes = nodes_of(spark, corpus)
    want = [folded(t)[2] for t in corpus[:-2]]
    rows = N.mu_vectors(nodes).collect()
    assert [sorted((r.in_degree, r.vector) for r in rows if r.tree_id == i) for i in range(len(want))] == want
    live = N.live_nodes(nodes)
    key = lambda d: sorted(tuple(r) for r in d.select("tree_id", "node", "in_degree", "vector").collect())
    assert sorted(map(tuple, rows)) == key(N.path_vectors(nodes, N.suppressed(N.network_edges(live))))
    # numbers of nodes need not be places
    spread = nodes.select("tree_id", *((F.col(c) * 10 + 7).alias(c) for c in ("lo", "hi", "parent_lo")), "depth", "is_leaf", "label", "dist")
    place = lambda n: n * 10 + 7 if n >= 0 else -((-n - 1) * 10 + 7) - 1
    assert sorted(map(tuple, N.mu_vectors(spread).collect())) == sorted((t, place(n), i, v) for t, n, i, v in map(tuple, rows))


def test_measures_of_packed_pairs(spark, corpus):
    """The measures of a pair, in one row, are those of the operators over all pairs."""
    rng = random.Random(3)
    other = [*rng.sample(corpus, len(corpus))]
    a, b = nodes_of(spark, corpus), nodes_of(spark, other)
    sides = []
    for nodes in (a, b):
        live = N.live_nodes(nodes)
        edges = N.suppressed(N.network_edges(live))
        sides.append((N.reticulation_leaves(nodes, N.reticulations(nodes, live)).persist(), N.sister_sets(nodes, live).persist(), N.path_vectors(nodes, edges), N.network_class(nodes, edges)))
    (l, s, v, c), (m, t, w, d) = sides
    near = lambda got, want: [[x if x is None else round(x, 9) for x in r] for r in sorted(map(tuple, got.collect()))] == [[x if x is None else round(x, 9) for x in r] for r in sorted(map(tuple, want.collect()))]
    assert near(N.mu_distances(a, b), N.scored_mu_distance(N.mu_distance(v, w), c, d))
    by_sister = N.sister_set_distances(a, b)
    assert by_sister.columns == ["tree_id", *N.FORMS]
    assert near(by_sister, N.sister_set_distance(N.match_reticulations(l, m), l, m, s, t))
    one, none = a.filter("tree_id < 20"), b.filter("tree_id >= 20")
    assert {r.dist for r in N.sister_set_distances(one, none).collect()} == {1.0}


def test_comparisons_move_no_nodes(spark):
    """Trees are shuffled by tree alone, once a side, and nothing is written in between."""
    nodes = nodes_of(spark, [("a", ("a", "b"))])
    by_tree = spark.createDataFrame(nodes.collect(), nodes.schema).repartition(5, "tree_id")
    assert shuffles(N.mu_distances(by_tree, by_tree)) == shuffles(N.sister_set_distances(by_tree, by_tree)) == 2 and shuffles(N.mu_vectors(by_tree)) == 1


def test_a_pair_without_trees_fails(spark):
    nodes = nodes_of(spark, [("a", ("a", "b")), (("a", "b"), "a")])
    pairs = spark.createDataFrame([("n", "c", "grampa", 1, 0, 1), ("n", "c", "padre", 2, 0, 9), ("n", "c", "padre", 3, 0, None)], "network string, config string, method string, replicate int, truth_id long, inferred_id long")
    rows = N.compare_networks(nodes, nodes, pairs).collect()
    assert sorted((r.replicate, r.metric, r.value, r.jaccard_mode, r.status) for r in rows if r.replicate > 1) == [(2, "FAILED", None, None, "FAILED"), (3, "FAILED", None, None, "FAILED")]
    found = {r.metric: r.value for r in rows if r.replicate == 1}
    assert len(found) == 25 and found["num_rets_diff"] == 0.0 and found["ploidy_diff.dist"] == 0.0 and {r.jaccard_mode for r in rows if r.replicate == 1} == {"partial"}


def test_labels_are_kept_as_they_are(spark):
    labels = ['a"b', "c,d", "e\\f\n", "é"]
    rows = [(0, 0, 4, 0, None, False, None, 0.0)] + [(0, i + 1, i + 1, 1, 0, True, x, 1.0) for i, x in enumerate(labels)]
    nodes = spark.createDataFrame(rows, "tree_id long, lo long, hi long, depth int, parent_lo long, is_leaf boolean, label string, dist double")
    assert {r.vector for r in N.mu_vectors(nodes).collect() if r.in_degree} == {f"{x}:1" for x in labels}
    assert P.network(P.packed(nodes).first().text).counts == dict.fromkeys(labels, 1)
