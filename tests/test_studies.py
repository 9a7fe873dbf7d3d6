"""Operators on studies, partners and backbones over small tables worked out by hand: nulls, ties and empty parts."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import names as P
from cladeframe.operators import backbones as B
from cladeframe.operators import features as X
from cladeframe.operators import labels as L
from cladeframe.operators import partners as Q
from cladeframe.operators import sequences as SQ
from cladeframe.operators import summaries as S
from cladeframe.operators import trees as T
from cladeframe.sources import readers as R


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_retention_summaries(spark):
    text = '{"events": [{"species": ["a", "b"], "q": 0.4}, {"species": ["a"], "q": null}], "copy_numbers": {"a": {"1": 3, "2": 5}, "b": {"4": 1}, "c": {"1": 9}}, "removal": {"g": {"eligible": 4, "reduced": 1}, "h": {"eligible": 2}}}'
    files = spark.createDataFrame([("n", 1, text), ("n", 2, "no json"), ("n", 3, "{}"), ("m", 1, None)], "network string, replicate int, value string")
    copies, removal, rates = R.parse_retention(files)
    assert got(copies) == [("n", 1, "a", 1, 3), ("n", 1, "a", 2, 5), ("n", 1, "b", 4, 1)]
    assert got(removal) == [("n", 1, "g", 4, 1), ("n", 1, "h", 2, 0)] and got(rates) == [("n", 1, 0.4), ("n", 1, None)]
    study = {r.network: (r.replicates, r.polyploids, r.mean_copies, r.retention) for r in S.retention_study(copies, removal).collect()}
    assert study["n"] == study[None] == (1, 2, pytest.approx(17 / 9), pytest.approx(5 / 6))


def test_ranks_with_completion(spark):
    rows = [("a", "x", 1.0), ("b", "x", 1.0), ("a", "y", 2.0), ("c", "y", 1.0), ("b", "y", None)]
    df = spark.createDataFrame([(m, k, v, "SUCCESS" if v else "FAILED") for m, k, v in rows], "method string, metric string, value double, status string")
    inventory = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", False)], "method string, inferred_exists boolean")
    ranks = {r.method: (r.mean_rank, r.completion_rank, r.measures) for r in S.ranks_with_completion(df, inventory).collect()}
    assert ranks == {"a": (pytest.approx((1.5 + 2 + 2) / 3), 2.0, 3), "b": (pytest.approx((1.5 + 3 + 1) / 3), 1.0, 3), "c": (pytest.approx((3 + 1 + 3) / 3), 3.0, 3)}


def test_matched_runs_and_best_methods(spark):
    runs = spark.createDataFrame([("n", 1, "a", 0.0, True), ("n", 2, "a", 0.5, False), ("n", 1, "b", 0.2, False), ("n", 2, "b", 0.0, True), ("m", 1, "a", 0.0, True)], "network string, replicate int, method string, value double, copies_match boolean")
    assert got(S.matched_copies(runs, "a")) == [("a", 2, 100.0, 0.0, 100.0), ("b", 1, 50.0, 0.2, 0.0)]
    assert S.matched_copies(runs, "none").collect() == []
    rows = spark.createDataFrame([("n", 0, "b", 1.0), ("n", 0, "a", 1.0), ("n", 0, "c", 4.0), ("m", 0, "c", 2.0), ("m", 0, "a", None)], "network string, metric int, method string, value double").withColumn("status", F.when(F.col("value").isNotNull(), "SUCCESS").otherwise("FAILED"))
    assert got(S.best_per_network(rows)) == [("m", 0, "c", 2.0, None), ("n", 0, "a", 1.0, 0.0)]


def test_partner_errors(spark):
    rows = [(1, 1, 2, 1, ["a"], ["a"]), (1, 2, 3, 3, ["a"], ["a"]), (1, 3, 9, 4, ["a", "b"], ["b"]), (1, 4, 9, 3, ["a"], ["b"]), (2, 5, 6, 7, ["a", None], ["b"]), (2, 6, 1, 7, None, ["b"])]
    df = spark.createDataFrame(rows, "sample_id int, edge int, partner int, predicted int, clade array<string>, predicted_clade array<string>")
    assert got(L.partner_errors(df)) == [(1, "reciprocal", 2), (1, "self", 1), (2, "far", 2)]
    assert got(L.partner_errors(df.filter("edge <> 4"))) == [(1, "near", 1), (1, "self", 1), (2, "far", 2)]


def test_histograms(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "x int")
    assert got(L.histogram(df, "x", (1, 4))) == [("x", "<= 1", 1, 0.25), ("x", "<= 4", 2, 0.5), ("x", "> 4", 1, 0.25)]
    assert got(L.histogram(df, "x")) == [("x", "1", 1, 0.25), ("x", "2", 2, 0.5), ("x", "9", 1, 0.25)] and L.histogram(df.limit(0), "x").collect() == []
    totals = L.corpus_totals(spark.createDataFrame([(3, 5, 2, 1), (5, 9, 0, None)], "n_species int, n_leaves int, requested int, applied int")).first()
    assert (totals.samples, totals.without_events, totals.success, totals.n_species_mean) == (2, 1, 0.5, 4.0)


def test_alignments_without_a_report_pass_its_limits(spark):
    df = spark.createDataFrame([(1, 900, 4.0, 50.0), (2, 10, 60.0, 10.0), (3, 900, None, None)], "gene int, length int, informative_percentage double, constant_percentage double")
    assert [r.reasons for r in SQ.quality_check(df, 500, least_informative=5.0, most_constant=40.0).orderBy("gene").collect()] == [["few informative sites", "constant"], ["short"], []]


def test_edges_by_rounds_as_one_by_one(spark):
    rng = random.Random(4)
    edges = [(s, e, rng.choice([0.2, 0.4, 0.6, 0.8, rng.random()]), rng.sample("abcdefgh", rng.randint(1, 4))) for s in range(8) for e in range(40)]
    edges += [(99, e, 1 - e / 400, [f"x{e}", f"x{e + 1}"]) for e in range(60)]  # each waits for the one before
    bounds = {x: rng.randint(1, 5) for x in "abcdefgh"}
    table = spark.createDataFrame([(s, e, p, x, bounds.get(x, 2)) for s, e, p, xs in edges for x in xs], "sample_id int, edge_ix int, prob double, species string, bound int")
    for strategy in ("cap", "bound_driven", "detect"):
        want, held = [], {}
        for s, e, p, xs in sorted(edges, key=lambda r: (r[0], -r[2], r[1])):
            fits = all(held.get((s, x), 1) < bounds.get(x, 2) for x in xs)
            if fits and (strategy != "cap" or p >= 0.5):
                held |= {(s, x): held.get((s, x), 1) + 1 for x in xs}
                want.append((s, e))
            elif strategy == "detect" and p >= 0.5:
                want.append((s, e))
        assert sorted(got(L.select_edges(table, strategy, 0.5))) == sorted(want)


def test_root_names_and_levels(spark):
    names = spark.createDataFrame([(x,) for x in ("a_2", "a_10", "a", "b_c_1", "b_c", "_3", "x_", "a_2")], "name string")
    assert {r.root: r.names for r in P.root_names(names).collect()} == {"a": ["a", "a_2", "a_10"], "b_c": ["b_c", "b_c_1"], "_3": ["_3"], "x_": ["x_"]}
    configs = spark.createDataFrame([("ILS_Low",), ("mine",), ("other",), (None,)], "config string")
    tags = spark.createDataFrame([("mine", "own", "deep")], "config string, family string, level string")
    assert got(P.tag_configs(configs, tags)) == sorted([("ILS_Low", "Unknown", "low"), ("mine", "own", "deep"), ("other", "Unknown", "Unknown"), (None, "Unknown", "Unknown")], key=str)
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "species string")
    listed = spark.createDataFrame([("a",), ("a",)], "taxon string")
    assert got(P.keep_listed(rows, listed)) == [("a",)] and got(P.keep_listed(rows, listed, drop=True)) == [("b",), (None,)]


@pytest.fixture(scope="module")
def nodes(spark):
    trees = [(1, "((A:1,B:1):1,(A:1,(C:1,D:5):1):1);"), (2, "((A:1,C:1):1,(B:2,D:2):1);"), (3, "((A:2,B:2):1,(C:1,D:1):1);"), (4, "(B:1,D:1);")]
    return T.parse_newick(spark.createDataFrame(trees, "tree_id long, newick string")).withColumn("sample_id", F.lit(7)).persist()


def test_candidates_of_all_scorers(spark, nodes):
    positions = Q.candidate_positions(nodes, spark.createDataFrame([(7, "A"), (7, "none")], "sample_id int, species string"))
    by = {}
    for r in positions.collect():
        by.setdefault(r.scorer, {})[r.partner] = r.position
    # A's sisters: B in trees 1 and 3, C in 2; duplicated in tree 1 alone; mean distances B (2 + 5 + 4) / 3, C (3 + 2 + 5) / 3, D (7 + 5 + 5) / 3
    assert by == {"coclustering": {"B": 1, "C": 2}, "contrast": {"B": 1, "C": 2}, "distance": {"C": 1, "B": 2, "D": 3}, "rank_sum": {"B": 1, "C": 2, "D": 3}}
    events = spark.createDataFrame([(7, "A", "C"), (7, "A", "D"), (7, "C", "B")], "sample_id int, species string, partner string")
    found = {r.scorer: (r.n, r.listed, r.top1, r.top2, r.top3) for r in Q.partner_recovery(positions, events).collect()}
    assert found == {"coclustering": (3, 1, 0.0, 1.0, 1.0), "contrast": (3, 1, 0.0, 1.0, 1.0), "distance": (3, 2, 0.5, 0.5, 1.0), "rank_sum": (3, 2, 0.0, 0.5, 1.0)}


def test_what_stands_in_a_partners_place(spark, nodes):
    events = spark.createDataFrame([(7, "A", "B"), (7, "A", "D"), (7, "C", "B"), (7, "E", "A")], "sample_id int, species string, partner string")
    # C's first candidate is D (2 of 4 trees); D is the true partner of another event, and a sister of B in two trees
    assert got(Q.confusers(nodes, events)) == [(7, "diploid", 2, 2, 2, 0.5), (7, "none", 1, 0, 0, None), (7, "partner", 1, 0, 0, None)]


def test_backbones(spark):
    true = [(1, "(((a,b),c),(d,(e,f)));"), (2, "(((a,b),c),(d,(e,f)));"), (3, "((a,b),(c,d));")]
    inferred = [(1, "(((a,b),c),(d,(e,f)));"), (2, "(((a,x),c),(d,(e,f)));"), (3, "((a,c),(b,d));")]
    inferred[1] = (2, "(((a,c),b),(d,(e,f)));")
    t, i = (T.parse_newick(spark.createDataFrame(x, "tree_id long, newick string")) for x in (true, inferred))
    diploids = spark.createDataFrame([(x,) for x in "acdefz"], "species string")
    errors = {r.tree_id: tuple(r)[1:] for r in B.backbone_errors(i, t, diploids).collect()}
    assert errors == {1: (0, 0.0, 0, 0.0), 2: (2, pytest.approx(1 / 3), 0, 0.0), 3: (2, 1.0, 0, 0.0)}
    summary = B.backbone_summary(B.backbone_errors(i, t, diploids).withColumn("sample_id", F.lit(1))).first()
    assert (summary.n, summary.full_exact, summary.pruned_exact, summary.gain) == (3, pytest.approx(1 / 3), 1.0, pytest.approx(4 / 9))
    scores = spark.createDataFrame([(0, 1.0, 0.8, 0.6), (4, 2.0, 1.0, 2.0)], "rf int, inferred double, rerooted double, true double")
    assert got(B.three_way(scores), "topology", "n", "closed") == [("all", 2, pytest.approx(3.0)), ("exact", 1, pytest.approx(0.5)), ("wrong", 1, None)]
    buckets = {r.bucket: (r.n, r.mean_gap) for r in B.backbone_buckets(spark.createDataFrame([(0.0, 1.0), (0.05, 2.0), (0.06, 3.0), (1.5, 4.0)], "normalised double, gap double")).collect()}
    assert buckets == {"<= 0": (1, 1.0), "<= 0.05": (1, 2.0), "<= 0.1": (1, 3.0), "over": (1, 4.0), "all": (4, 2.5)}


def test_profiles_and_thresholds(spark):
    counts = spark.createDataFrame([(1, "a", "b", 1, 3), (1, "a", "c", 2, 3)], "sample_id int, species string, partner string, k long, total long")
    species = spark.createDataFrame([(1, x) for x in "abcd"], "sample_id int, species string")
    rows = {r.species: (r.mean, r.std, r.max, r.min, r.median) for r in X.profile_summary(counts, species).collect()}
    assert rows["a"] == tuple(pytest.approx(x) for x in (1 / 3, (2 / 27) ** 0.5, 2 / 3, 0.0, 1 / 3)) and rows["d"] == (0.0,) * 5
    clusters = spark.createDataFrame([(1, s) for s in (1, 2, 3, 10)], "sample_id int, support long")
    kept = lambda *a: sorted(r.support for r in X.filter_clusters(clusters, *a).collect())
    assert kept("percentile", 0.25, 3.0) == [3, 10] and kept("percentile", 0.25) == [2, 3, 10] and kept("median_std", 0.5) == [1, 2, 3, 10] and kept("median_std", 0.2) == [2, 3, 10]


def test_mean_share_at_a_tie_of_rounding(spark):
    counts = spark.createDataFrame([(1, "a", f"p{i}", 1, 240) for i in range(9)], "sample_id int, species string, partner string, k long, total long")
    species = spark.createDataFrame([(1, x) for x in ("a", *(f"p{i}" for i in range(24)))], "sample_id int, species string")
    mean = lambda **how: {r.species: r.mean for r in X.profile_summary(counts, species, **how).collect()}["a"]
    assert mean() == 0.0015625 and mean(whole=False) == sum([1 / 240] * 9) / 24 < 0.0015625


def test_basal_frequencies(spark):
    splits = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["a", "b"]), (1, 3, ["b"])], "sample_id int, tree_id int, side array<string>")
    species = spark.createDataFrame([(1, x) for x in "abcd"], "sample_id int, species string")
    found = T.basal_frequencies(splits, species)
    assert got(found, "species", "basal") == [("a", 2), ("b", 2), ("c", 0), ("d", 0)]
    clades = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b"), ("rest", "c"), ("all", "a"), ("all", "b"), ("all", "c"), ("all", "d")], "clade string, species string")
    assert got(T.basal_clades(found, clades)) == [(1, "one", pytest.approx(1 / 3, abs=1e-8))]
