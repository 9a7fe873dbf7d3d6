"""Preorder structures against trees walked by hand."""

import itertools
import random

import pytest

from cladeframe.operators import preorder as O
from cladeframe.operators import trees as T


def random_tree(rng, names):
    parts = [(n, rng.choice([0.25, 1.0, 2.5, 7.0])) for n in names]
    while len(parts) > 1:
        k = min(len(parts), rng.choice([2, 2, 2, 3, 4]))
        rng.shuffle(parts)
        parts = parts[k:] + [(parts[:k], rng.choice([0.0, 0.5, 1.0, 3.0]))]
    return parts[0][0] if isinstance(parts[0][0], list) else [parts[0]]


def text(tree):
    return "(" + ",".join((f if isinstance(f, str) else text(f)) + f":{d}" for f, d in tree) + ")"


def tips(tree, far=0.0, path=()):
    """Name, distance, and the inner nodes above as (id, distance)."""
    path = (*path, (id(tree), far))
    for f, d in tree:
        if isinstance(f, str):
            yield f, far + d, path
        else:
            yield from tips(f, far + d, path)


def apart(a, b):
    over = max(f for (i, f) in a[2] if (i, f) in b[2])
    return round(a[1] + b[1] - 2 * over, 6)


def clusters(tree):
    """The sets of names below every inner node."""
    own, out = set(), []
    for f, _ in tree:
        if isinstance(f, str):
            own.add(f)
        else:
            sub = clusters(f)
            own |= sub[-1]
            out += sub
    return [*out, own]


def splits(tree, kept):
    every = clusters(tree)[-1] & kept
    return {frozenset((frozenset(c & kept), frozenset(every - c))) for c in clusters(tree) if len(c & kept) > 1 and len(every - c) > 1}


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(4)
    return {i: random_tree(rng, rng.choices("ABCDEFG", k=rng.randint(1, 14))) for i in range(40)}


@pytest.fixture(scope="module")
def nodes(spark, forest):
    return T.parse_newick(spark.createDataFrame([(i, text(t) + ";") for i, t in forest.items()], "tree_id long, newick string")).persist()


def test_distances(nodes, forest):
    got = {(r.tree_id, r.species, r.distance) for r in O.tip_distances(nodes).collect()}
    assert got == {(i, n, f) for i, t in forest.items() for n, f, _ in tips(t)}


def test_copies(nodes, forest):
    want = sorted((i, a[0], apart(a, b)) for i, t in forest.items() for a, b in itertools.combinations(list(tips(t)), 2) if a[0] == b[0])
    assert sorted((r.tree_id, r.species, round(r.distance, 6)) for r in O.copy_pairs(nodes).collect()) == want


def test_nearest_species(nodes, forest):
    want = {}
    for i, t in forest.items():
        for a, b in itertools.permutations(list(tips(t)), 2):
            if a[0] in "AB" and a[0] != b[0]:
                key = (i, a[0], b[0])
                want[key] = min(want.get(key, 1e9), apart(a, b))
    asked = nodes.filter("label in ('A', 'B')").select("tree_id", nodes.label.alias("species"))
    assert {(r.tree_id, r.species, r.other): round(r.distance, 6) for r in O.nearest_species(nodes, asked).collect()} == want


def test_heights_and_sizes(nodes, forest):
    def measured(tree, depth=0):
        below = [measured(f, depth + 1) if not isinstance(f, str) else [(0, 1)] for f, _ in tree]
        own = (1 + max(b[-1][0] for b in below), sum(b[-1][1] for b in below))
        return [x for b in below for x in b] + [own]

    heights = {}
    for r in O.with_height(nodes).collect():
        heights.setdefault(r.tree_id, []).append(r.height)
    sizes = {}
    for r in O.walked(nodes).collect():
        sizes.setdefault(r.tree_id, []).append(r.last - r.first + 1)
    assert {i: sorted(h) for i, h in heights.items()} == {i: sorted(h for h, _ in measured(t)) for i, t in forest.items()}
    assert {i: sorted(n) for i, n in sizes.items()} == {i: sorted(n for _, n in measured(t)) for i, t in forest.items()}


def test_lengths_from_topology(nodes, spark):
    got = O.ultrametric_lengths(nodes, 100.0)
    assert all(r.ultrametric and abs(r.height - 100) < 1e-6 for r in T.tree_heights(got, 1e-6).collect())
    one = T.parse_newick(spark.createDataFrame([(1, "((a,(b,c)),d);")], "tree_id long, newick string"))
    assert {r.label: r.dist for r in O.ultrametric_lengths(one, 3.0).filter("is_leaf").collect()} == {"a": 2.0, "b": 1.0, "c": 1.0, "d": 3.0}
    assert [r.dist for r in O.ultrametric_lengths(one, 3.0).filter("not is_leaf").orderBy("lo").collect()] == [None, 1.0, 1.0]


@pytest.mark.parametrize("kept", ["ABCDEFGHIJ", "ABCDEFG", "AB"])
def test_split_distances(spark, kept):
    rng = random.Random(9)
    names = "ABCDEFGHIJ"
    pairs = {i: (random_tree(rng, names), random_tree(rng, names)) for i in range(20)}
    pairs |= {20: (random_tree(rng, names), random_tree(rng, names + "A")), 21: (random_tree(rng, names), random_tree(rng, names[1:]))}
    pairs |= {22 + i: (t := random_tree(rng, names), t) for i in range(3)}
    one, two = (T.parse_newick(spark.createDataFrame([(i, text(p[k]) + ";") for i, p in pairs.items()], "tree_id long, newick string")) for k in (0, 1))
    rows = spark.createDataFrame([(i, s) for i in pairs for s in kept], "tree_id long, species string")
    got = {r.tree_id: (r.rf, round(r.normalised, 9)) for r in O.split_distances(one, two, None if kept == names else rows).collect()}
    want = {}
    for i, (a, b) in pairs.items():
        x, y = splits(a, set(kept)), splits(b, set(kept))
        named = [sorted(n for n, *_ in tips(t) if n in kept) for t in (a, b)]
        if named[0] == named[1] and len(set(named[0])) == len(named[0]):
            want[i] = (len(x ^ y), round(len(x ^ y) / (len(x) + len(y)), 9) if x or y else 0.0)
    assert got == want and got[23][0] == 0


def test_caterpillars_cost_a_row_a_node(spark):
    n = 2000
    rows = [(1, 2 * i, 2 * n - 2, i, 2 * i - 2 if i else None, False, None, 1.0) for i in range(n - 1)]
    rows += [(1, 2 * i + 1, 2 * i + 1, i + 1, 2 * i, True, f"s{i % 50}", 1.0) for i in range(n - 1)] + [(1, 2 * n - 2, 2 * n - 2, n - 1, 2 * n - 4, True, "last", 1.0)]
    nodes = spark.createDataFrame(rows, "tree_id long, lo long, hi long, depth int, parent_lo long, is_leaf boolean, label string, dist double")
    assert O.walked(nodes).count() == len(rows) and O.leaf_index(nodes).count() == n
    assert {(r.depth, r.height) for r in O.with_height(nodes).filter("not is_leaf").collect()} == {(i, n - 1 - i) for i in range(n - 1)}
    assert {r.lo: r.clade_size for r in T.edge_table(nodes).filter("clade_size > 1").collect()} == {2 * i: n - i for i in range(1, n - 1)}
    near = {r.other: r.distance for r in O.nearest_species(nodes, spark.createDataFrame([(1, "last")], "tree_id long, species string")).collect()}
    assert near == {f"s{s}": float(n - 1 - max(range(s, n - 1, 50)) + 1) for s in range(50)}


def test_empty(spark):
    nodes = spark.createDataFrame([], "tree_id long, lo long, hi long, depth int, parent_lo long, is_leaf boolean, label string, dist double")
    assert O.with_height(nodes).collect() == O.copy_pairs(nodes).collect() == O.split_distances(nodes, nodes).collect() == []


def test_pairs_of_copies_need_one_walk_and_no_join(spark):
    nodes = T.parse_newick(spark.createDataFrame([(1, "((a,b),(a,(a,c)));")], "tree_id long, newick string")).persist()
    pairs = O.copy_pairs(nodes)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("InMemoryRelation") == 1
    assert sorted(r.distance for r in pairs.collect()) == [0.0] * 3


def test_steps_read_several_times_are_written_once(spark):
    from cladeframe.operators import backbones as B

    nodes = T.parse_newick(spark.createDataFrame([(1, "((a,b),(c,(d,e)));")], "tree_id long, newick string")).persist()
    diploids = spark.createDataFrame([(s,) for s in "abcd"], "species string")
    for found in (O.ultrametric_lengths(nodes), B.backbone_errors(nodes, nodes, diploids)):
        assert "InMemoryRelation" not in found._jdf.queryExecution().optimizedPlan().toString()  # plans end at written tables
