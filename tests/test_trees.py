"""Operators on small trees worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import names as P
from cladeframe.operators import features as X
from cladeframe.operators import labels as L
from cladeframe.operators import networks as N
from cladeframe.operators import summaries as S
from cladeframe.operators import trees as T
from cladeframe.sources import readers as R

SPECIES = "((A:1,B:1):1,(C:1,(D:1,E:1):1):1);"
ALLO = "((A,(B,D)),(C,(D,E)));"
AUTO = "((A,(B,C)),((D,E),(D,E)));"


@pytest.fixture(scope="module")
def nodes(spark):
    corpus = spark.createDataFrame([(1, SPECIES), (2, ALLO), (3, AUTO)], "tree_id long, newick string")
    return T.parse_newick(corpus).persist()


def clades(nodes, tree):
    by = {}
    for r in T.clade_members(nodes).filter(F.col("tree_id") == tree).collect():
        by.setdefault(r.lo, set()).add(r.species)
    return sorted("".join(sorted(s)) for s in by.values())


def test_parse_newick(nodes):
    assert clades(nodes, 2) == ["ABD", "ABCDE", "BD", "CDE", "DE"] or clades(nodes, 2) == sorted(["ABD", "ABCDE", "BD", "CDE", "DE"])
    one = {r.lo: r for r in nodes.filter("tree_id = 1").collect()}
    assert [one[i].label for i in sorted(one) if one[i].is_leaf] == list("ABCDE")
    assert (one[0].hi, one[0].depth, one[0].parent_lo, one[0].dist) == (8, 0, None, None)
    assert (one[6].depth, one[6].parent_lo, one[6].hi, one[6].dist) == (2, 4, 8, 1.0)


def test_parse_newick_with_inner_labels_and_lone_leaf(spark):
    got = {(r.tree_id, r.lo): r for r in T.parse_newick(spark.createDataFrame([(1, "(a:0.5,(b,c)x:2e-1)root;"), (2, "lone;"), (3, None)], "tree_id long, newick string")).collect()}
    assert (got[1, 2].label, got[1, 2].dist, got[1, 0].label, got[1, 1].dist) == ("x", 0.2, "root", 0.5)
    assert got[2, 0].is_leaf and got[2, 0].label == "lone" and len(got) == 6


def test_fold_finds_allo_and_auto_events(nodes):
    rets = {r.tree_id: r for r in N.fold(nodes, 4).collect()}
    assert set(rets) == {2, 3}
    assert (rets[2].k, rets[2].d, rets[2].auto_events, rets[2].allo_events, rets[2].allo_group) == (2, 2, 0, 1, 1)
    assert (rets[3].k, rets[3].d, rets[3].auto_events, rets[3].allo_events, rets[3].allo_group) == (2, 1, 1, 0, 0)
    leaves = {(r.tree_id, r.species) for r in N.reticulation_leaves(nodes, N.fold(nodes, 4)).collect()}
    assert leaves == {(2, "D"), (3, "D"), (3, "E")}


def test_copy_statistics_of_ten_trees(spark):
    corpus = spark.createDataFrame([(i, ALLO if i < 7 else SPECIES) for i in range(10)], "tree_id long, newick string")
    leaves = T.leaves(T.parse_newick(corpus)).withColumn("sample_id", F.lit(1))
    copies = X.copies_per_tree(leaves)
    d = X.copy_features(copies).filter("species = 'D'").first()
    assert [round(x, 6) for x in (d["mean"], d.variance, d.mode, d.p1, d.p2, d.most)] == [1.7, 0.21, 2, 0.3, 0.7, 2]
    assert {r.species: r.bound for r in X.consensus_bound(copies).collect()} == {"A": 1, "B": 1, "C": 1, "D": 2, "E": 1}
    assert {r.species: r.copies for r in X.representative_copies(X.copy_distribution(copies)).collect()}["D"] == 2


def test_canonical_codes_ignore_child_order(spark):
    a = T.parse_newick(spark.createDataFrame([(1, "((a,b),(c,d));"), (2, "((d,c),(b,a));"), (3, "((a,c),(b,d));")], "tree_id long, newick string"))
    assert sorted((r.tree_id, r.n_trees) for r in T.collapse_identical(a, 2).collect()) == [(1, 2), (3, 1)]


def test_distances_obey_the_metric_laws(nodes):
    copies = N.leaf_counts(nodes)
    for r in N.ploidy_difference(copies, copies).collect():
        assert (r.dist, r.fp, r.fn) == (0.0, 0, 0)
    one = copies.filter("tree_id = 1").withColumn("tree_id", F.lit(9))
    two = copies.filter("tree_id = 2").withColumn("tree_id", F.lit(9))
    assert N.ploidy_difference(one, two).first().dist == N.ploidy_difference(two, one).first().dist == 1.0
    left = nodes.sparkSession.createDataFrame([(1, 1, "A"), (1, 1, "B"), (1, 2, "C")], "tree_id int, ret_id int, species string")
    same = N.leaf_set_distance(N.match_reticulations(left, left), left, left).first()
    assert (same.dist, same.fp, same.fn) == (0.0, 0.0, 0.0)


def test_edge_selection_keeps_bounds(spark):
    rows = [(1, 0, 0.9, "a", 2), (1, 0, 0.9, "b", 2), (1, 1, 0.8, "a", 2), (1, 2, 0.4, "b", 2), (1, 3, 0.3, "c", 2), (2, 0, 0.2, "a", 2)]
    df = spark.createDataFrame(rows, "sample_id int, edge_ix int, prob double, species string, bound int")
    take = lambda s: sorted(tuple(r) for r in L.select_edges(df, s, 0.5).collect())
    assert take("detect_only") == [(1, 0), (1, 1)] and take("cap") == [(1, 0)]
    assert take("bound_driven") == [(1, 0), (1, 3), (2, 0)] and take("detect") == [(1, 0), (1, 1), (1, 3), (2, 0)]
    with pytest.raises(ValueError):
        L.select_edges(df, "other", 0.5)


def test_p_value_of_a_correlation(spark):
    rows = [(0.5, 12), (0.0, 9), (1.0, 9), (0.3, 4), (-0.3, 4), (0.2, 3), (None, 8), (0.4, 2), (0.9, 40), (0.01, 50_000)]
    got = [(r.p, r.significant) for r in S.with_p_values(spark.createDataFrame(rows, "r double, n long")).collect()]
    want = [0.09785, 1.0, 0.0, 0.7, 0.7, 1 - 2 / math.pi * math.asin(0.2), None, None]
    assert [p for p, _ in got[:8]] == [w if w is None else pytest.approx(w, abs=1e-5) for w in want]
    assert got[8][0] == pytest.approx(2.5e-15, rel=0.3) and got[9][0] == pytest.approx(math.erfc(0.01 * math.sqrt(49_998) / math.sqrt(1 - 1e-4) / math.sqrt(2)), rel=1e-3)



def test_readers(spark, tmp_path):
    (tmp_path / "a.tre").write_text("(a,b);\n\n(c,d);\n")
    (tmp_path / "n.nex").write_text("#NEXUS\nbegin trees;\n  tree t1 = [&R] ((x,y),z);\nend;\n")
    assert sorted((r.number, r.newick) for r in R.read_newick(spark, str(tmp_path / "a.tre")).collect()) == [(0, "(a,b)"), (1, "(c,d)")]
    assert R.read_nexus(spark, str(tmp_path / "n.nex")).first().newick == "((x,y),z)"
    text = lambda t: spark.createDataFrame([("p/net/results/cfg/m/replicate_3/x", t)], "path string, value string")
    assert [tuple(r)[1:] for r in R.parse_phylip(text("2 4\ns1  AC GT\ns2  ACGG\n")).collect()] == [("s1", "ACGT"), ("s2", "ACGG")]
    assert [tuple(r)[1:] for r in R.parse_fasta(text(">s1 x\nAC\nGT\n>s2\nA\n")).collect()] == [("s1", "ACGT"), ("s2", "A")]
    assert R.parse_durations(text("COMPLETED SUCCESSFULLY\nElapsed: 1:02:03")).first().seconds == 3723
    assert [tuple(r)[1:] for r in R.parse_copy_table(text("Species copies\na 2\nb x\n")).collect()] == [("a", 2)]
    assert R.parse_result_tree(text("x\nmultree: (a,b);\n")).first().newick == "(a,b);"
    assert R.parse_result_tree(text("h1\th2\n1\t(a,c);\n")).first().newick == "(a,c);"
    assert tuple(R.keys_from_path(text("")).first())[2:] == ("net", "cfg", "m", 3)


def test_names(spark):
    df = spark.createDataFrame([("Aus_bus_1_7_2",)], "gene string")
    leaf, copy = P.gene_tip("gene")
    assert tuple(df.select(leaf, copy).first()) == ("Aus_bus_1", 1)
    taxa = spark.createDataFrame([("ab",), ("abc",), ("abX",)], "taxon string")
    assert {r.taxon: r.name for r in P.safe_names(P.substring_taxa(taxa).select("taxon"), taxa).collect()} == {"ab": "abX1"}
    got = P.harmonise(spark.createDataFrame([("A_bus12",), ("Abus",), ("Cus",)], "name string"), spark.createDataFrame([("Abus",)], "name string"))
    assert {r.name: r.canonical for r in got.collect()} == {"A_bus12": "Abus", "Abus": "Abus"}
    row = spark.createDataFrame([(1.0, 2.0, 0.5, 4.0)], "a double, b double, alpha double, big double")
    assert row.select(P.substitution_model(row, ["a"], ["b"])).first()[0] == "GTR{1.0000}+F{2.0000}+G4{0.5000}"
    assert row.select(P.substitution_model(row, ["a"], ["b"], "big")).first()[0] == "GTR{1.0000}+F{2.0000}"


def test_mu_vectors_and_distance(spark, nodes):
    """The allo network: D has two parents, so the root reaches it twice; the auto one suppresses its doubled clade."""
    mu = N.mu_vectors(nodes, 4)
    allo = sorted((r.in_degree, r.vector) for r in mu.filter("tree_id = 2").collect())
    assert (0, "A:1,B:1,C:1,D:2,E:1") in allo and (2, "D:1") in allo and (1, "D:1") in allo and len(allo) == 11  # the reticulation above D, and D
    assert {r.distance for r in N.mu_distance(mu, mu).collect()} == {0.0}
    one, two = mu.filter("tree_id = 1").withColumn("tree_id", F.lit(9)), mu.filter("tree_id = 2").withColumn("tree_id", F.lit(9))
    d = N.mu_distance(one, two).first().distance
    assert 0 < d < 1 and d == N.mu_distance(two, one).first().distance


def test_robinson_foulds(spark):
    a = T.parse_newick(spark.createDataFrame([(1, "((a,b),((c,d),e));"), (2, "((b,a),(e,(d,c)));"), (3, "((a,c),((b,d),e));"), (4, "((a,a),b);")], "tree_id long, newick string"))
    own = T.bipartitions(a).withColumn("key", F.lit(1))
    got = {r.tree_id: (r.rf, r.normalised) for r in T.robinson_foulds(own, own.filter("tree_id = 1").select("key", "side")).collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.0), 3: (4, 1.0)}
