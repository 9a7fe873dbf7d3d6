import pytest
from pyspark.sql import functions as F

from cladeframe.operators import networks as N
from cladeframe.operators import trees as T


def test_a_chain_of_six_reticulations_is_matched_to_its_end(spark):
    left, right = {i: set() for i in range(6)}, {i: set() for i in range(6)}
    for i in range(6):
        for b, shared in ((i, 12 - 2 * i), (i - 1, 13 - 2 * i)):  # each prefers the one matched a round earlier
            for j in range(shared if b >= 0 else 0):
                left[i].add(f"s{i}.{b}.{j}")
                right[b].add(f"s{i}.{b}.{j}")
    rows = lambda d, side: spark.createDataFrame([(1, i, x) for i, s in d.items() for x in [*s, *(f"{side}{i}.{j}" for j in range(30 - len(s)))]], "tree_id long, ret_id long, species string")
    got = N.match_reticulations(rows(left, "l"), rows(right, "r")).collect()
    assert sorted((r.a, r.b, r.shared) for r in got) == [(i, i, 12 - 2 * i) for i in range(6)]


def test_trees_that_differ_only_far_down(spark):
    deep = lambda inner: "(x0," * 9 + inner + ")" * 9 + ";"
    nodes = T.parse_newick(spark.createDataFrame([(1, deep("((a,b),(c,d))")), (2, deep("((a,c),(b,d))")), (3, deep("((d,c),(b,a))"))], "tree_id long, newick string"))
    assert sorted((r.tree_id, r.n_trees) for r in T.collapse_identical(nodes).collect()) == [(1, 2), (2, 1)]
    assert T.canonical_codes(nodes).count() == nodes.count()
    with pytest.raises(ValueError, match="depth 11"):
        T.collapse_identical(nodes, 2)


def random_tree(rng, n):
    """A nested tuple over a few labels; a third are caterpillars."""
    parts = [rng.choice("abcde") for _ in range(n)]
    shape = rng.randrange(3)
    while len(parts) > 1:
        i = 0 if shape == 0 else rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [(parts[i], parts[i + 1])]
    return parts[0]


def text_of(t):
    return t if isinstance(t, str) else "(" + ",".join(map(text_of, t)) + ")"


def folded(tree):
    """The network of a tree by the definition: from the greatest height down, like subtrees become one below a reticulation."""
    nodes, parent, kids = [], {}, {}

    def walk(t, up):
        me = len(nodes)
        nodes.append(t)
        parent[me], kids[me] = up, []
        if up is not None:
            kids[up].append(me)
        for c in () if isinstance(t, str) else t:
            walk(c, me)

    walk(tree, None)
    code, height, below = {}, {}, {}
    for i in reversed(range(len(nodes))):
        height[i] = 1 + max((height[c] for c in kids[i]), default=-1)
        code[i] = nodes[i] if not kids[i] else "(" + ",".join(sorted(code[c] for c in kids[i])) + ")"
        below[i] = [i, *(x for c in kids[i] for x in below[c])]
    edges = {(parent[i], i) for i in range(1, len(nodes))}
    gone, events = set(), {}
    for h in sorted(set(height.values()), reverse=True):
        groups = {}
        for i in range(len(nodes)):
            if height[i] == h:
                groups.setdefault(code[i], []).append(i)
        for first, *rest in groups.values():
            alive = [i for i in (first, *rest) if i not in gone]
            if len(alive) < 2:
                continue
            ret = -first - 1
            events[first] = (len(alive), len({parent[i] for i in alive}))
            edges |= {(parent[i], ret) for i in alive} | {(ret, first)}
            edges -= {(parent[i], i) for i in alive}
            for i in rest:
                gone |= set(below[i])
    edges = {(a, b) for a, b in edges if a not in gone and b not in gone}
    names = {i: {nodes[x] for x in below[i] if not kids[x]} for i in range(len(nodes))}
    sisters = sorted((i, p, tuple(sorted(set().union(*(names[c if c >= 0 else -c - 1] for a, c in edges if a == p and c != -i - 1))))) for i in events for p in {a for a, c in edges if c == -i - 1})
    while True:
        idle = [x for x in {b for _, b in edges} if sum(b == x for _, b in edges) == 1 and sum(a == x for a, _ in edges) == 1]
        if not idle:
            break
        up, down = next(a for a, b in edges if b == idle[0]), next(b for a, b in edges if a == idle[0])
        edges = {e for e in edges if idle[0] not in e} | {(up, down)}

    def paths(x):
        out = [b for a, b in edges if a == x]
        total = {}
        for c in out:
            for k, v in paths(c).items():
                total[k] = total.get(k, 0) + v
        return total if out else {nodes[x]: 1}

    members = {x for e in edges for x in e} or {0}
    ins = {x: sum(b == x for _, b in edges) for x in members}
    outs = {x: sum(a == x for a, _ in edges) for x in members}
    mu = sorted((ins[x], ",".join(f"{k}:{v}" for k, v in sorted(paths(x).items()))) for x in members)
    odd = sum((ins[x] != 1) if not outs[x] else (outs[x] != 1 if ins[x] > 1 else outs[x] != 2) for x in members)
    return events, sisters, mu, (sum(ins[a] > 1 and ins[b] > 1 for a, b in edges), odd)


def test_networks_against_the_definition(spark):
    import random

    rng = random.Random(5)
    trees = [random_tree(rng, n) for n in [1, 2, 2, 3, 4, 5, 6, 8, 8, 8, 11, 13, 16, 20] * 4]
    trees += [(("d", "e"), (("d", "e"), "a")), ((("b", "b"), "b"), "a"), (("a", "a"), ("a", "a"))]
    deep = "z"
    for i in range(25):
        deep = ("abc"[i % 3], deep)
    trees.append((deep, (("c", ("b", "z")), "z")))
    nodes = T.parse_newick(spark.createDataFrame([(i, text_of(t) + ";") for i, t in enumerate(trees)], "tree_id long, newick string")).persist()
    want = [folded(t) for t in trees]
    live = N.live_nodes(nodes)
    edges = N.suppressed(N.network_edges(live))
    by = lambda d, *c: [sorted(tuple(r[x] for x in c) for r in rows) for rows in ([r for r in got if r.tree_id == i] for got in [d.collect()] for i in range(len(trees)))]
    assert by(N.reticulations(nodes, live), "ret_id", "k", "d") == [sorted((i, *v) for i, v in w[0].items()) for w in want]
    assert by(N.sister_sets(nodes, live).withColumn("sisters", F.array_join("sisters", " ")), "ret_id", "side", "sisters") == [[(i, p, " ".join(s)) for i, p, s in w[1]] for w in want]
    assert by(N.path_vectors(nodes, edges), "in_degree", "vector") == [w[2] for w in want]
    assert by(N.network_class(nodes, edges), "stacked", "offending") == [[w[3]] for w in want]


def test_chains_of_idle_nodes(spark):
    """A chain of 200 nodes between two parallel ways, which become one, and then the node above them."""
    chain = [(1, i, i + 1) for i in range(1, 201)]
    edges = spark.createDataFrame([(1, 0, 1), *chain, (1, 0, 900), (1, 201, 300), (1, 201, 301), (1, 301, 310), (1, 301, 311), (1, 310, 312), (1, 311, 312), (1, 312, 313), (2, 5, 6)], "tree_id long, parent long, child long")
    got = sorted((r.tree_id, r.parent, r.child) for r in N.suppressed(edges).collect())
    assert got == [(1, 0, 201), (1, 0, 900), (1, 201, 300), (1, 201, 313), (2, 5, 6)]


def test_constant_columns_have_no_correlation(spark):
    from cladeframe.operators import summaries as S

    rows = [(float(i), 1.0, float(-2 * i), None if i == 3 else float(i)) for i in range(6)]
    got = spark.createDataFrame(rows, "x double, one double, y double, gap double").agg(S.correlation(F.col("x"), F.col("one")).alias("a"), S.correlation(F.col("x"), F.col("y")).alias("b"), S.correlation(F.col("one"), F.col("gap")).alias("c"), S.correlation(F.col("x"), F.col("gap")).alias("d")).first()
    assert got.a is None and got.c is None and got.b == pytest.approx(-1) and got.d == pytest.approx(1)
