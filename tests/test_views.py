"""The trees of any depth that are made in one pass are those of their SQL."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import networks as N
from cladeframe.operators import trees as T
from cladeframe.plans.views import DEEP, VIEWS, deep_trees, pair_trees

COLUMNS = ("tree_id", "sample_id", "lo", "hi", "depth", "parent_lo", "is_leaf", "label", "dist")


def test_deep_trees_are_those_of_the_sql(spark):
    sizes = [(t, n) for t, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 17, 31, 33, 63, 64, 65, 66, 100, 128, 130])]
    leaves = spark.createDataFrame([(t, t % 4, f"s{p % 5}", float(p), p) for t, n in sizes for p in range(n)], "tree_id long, sample_id long, clade string, dist double, pos int")
    want = spark.sql(DEEP.replace("LEAVES", "{l}"), l=leaves)
    rows = lambda d: sorted(map(repr, map(tuple, d.select(*COLUMNS).collect())))
    got = deep_trees(leaves)
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("text", [False, True])
def test_empty_leaves_make_no_trees(spark, text):
    leaves = spark.createDataFrame([], "tree_id long, sample_id long, clade string, dist double, pos long")
    made = deep_trees(leaves) if not text else spark.sql(DEEP.replace("LEAVES", "{l}"), l=leaves)
    assert made.agg(F.count("*")).first()[0] == 0


def test_pair_trees_are_those_of_the_sql(spark):
    leaves = spark.createDataFrame([(t, t % 4, f"s{p % 5}", f"c{p % 2}", float(p), p) for t, n in enumerate([1, 2, 3, 4, 5, 7, 8, 31]) for p in range(n)], "tree_id long, sample_id long, species string, clade string, dist double, pos int")
    want = spark.sql(VIEWS["v_nodes"].replace("{v_leaves}", "{l}"), l=leaves)
    rows = lambda d: sorted(repr(tuple(float(x) if isinstance(x, Decimal) else x for x in r)) for r in d.select(*COLUMNS).collect())
    got = pair_trees(leaves)
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def shuffled(d):
    return len(re.findall(r"Exchange hashpartitioning", d._jdf.queryExecution().executedPlan().toString()))


def test_folding_and_polytomies_shuffle_trees_once(spark):
    leaves = spark.createDataFrame([(t, 1, f"s{p % 3}", float(p), p) for t in range(5) for p in range(t + 1)], "tree_id long, sample_id long, species string, dist double, pos int")
    nodes = pair_trees(leaves)
    assert shuffled(N.fold(nodes)) == 1
    assert shuffled(T.repeated_in_polytomies(nodes)) == 1


def test_polytomies_of_pure_and_mixed_children(spark):
    text = [(1, "((a,b,a),c);"), (2, "(((a,a),b,(a,(a,a))),c);"), (3, "(((a,b),b,a),c);"), (4, "(a,b,a);"), (5, "(((a,a),(a,a)),c);"), (6, "((b,(a,a),(b,b),c),((a,a),a,d));")]
    nodes = T.parse_newick(spark.createDataFrame(text, "tree_id long, newick string"))
    by = {(r.tree_id, r.lo): (r.parent_lo, {x.label for x in nodes.filter(f"is_leaf and tree_id = {r.tree_id} and lo between {r.lo} and {r.hi}").collect()}) for r in nodes.collect()}
    want = []
    for (t, lo), (up, _) in by.items():
        sets = [(c, s) for (u, c), (p, s) in by.items() if u == t and p == lo]
        kinds = sorted({min(s) for _, s in sets})
        if up is not None and sets and all(len(s) == 1 for _, s in sets) and len(kinds) > 1 and len(sets) > len(kinds):
            want += [(t, lo, k, sum(s == {k} for _, s in sets), min(c for c, s in sets if s == {k})) for k in kinds]
    got = T.repeated_in_polytomies(nodes).select("tree_id", "lo", "species", "children", "kept").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_count_differences_side_by_side(spark):
    t, i = spark.createDataFrame([(1, 3), (2, 1)], "tree_id long, n long"), spark.createDataFrame([(1, 1), (3, 2)], "tree_id long, n long")
    both = spark.createDataFrame([(1, 3, 1), (2, 1, 0), (3, None, 2)], "tree_id long, t long, i long")
    assert sorted(map(tuple, N.count_difference(t, i).collect())) == sorted(map(tuple, N.count_differences(both).collect())) == [(1, -2, 2), (2, -1, 1), (3, 2, 2)]
