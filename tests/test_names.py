"""Names: the rules in their order, and that nothing is given up after some tries."""

import random

from pyspark.sql import functions as F

from cladeframe.functions import names as P


def test_harmonise_in_the_order_of_the_rules(spark):
    known = ["RSC04", "madagascariense", "foe1887", "cfpinnatumDLA2015", "Abus", "twin_a", "twin_b"]
    names = {"RSC04": "RSC04", "RSC040": "RSC04", "madagascariense0": "madagascariense", "foe_1887": "foe1887", "cf_pinnatum": "cfpinnatumDLA2015", "cf_pinnatum1": "cfpinnatumDLA2015", "A_BUS12": "Abus", "other7": "other", "nothing": None, "twin": None}
    one = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r.name: r.canonical for r in P.harmonise(one(names), one(known)).collect()}
    assert got == {k: v for k, v in names.items() if v}


def test_safe_names_beyond_any_number_of_tries(spark):
    taxa = ["a", "aX", *(f"aX{i}" for i in range(1, 40)), "b", "bXX3", "c(1)", "c(1)X2"]
    one = spark.createDataFrame([(t,) for t in taxa], "taxon string")
    got = {r.taxon: r.name for r in P.safe_names(one.filter("taxon in ('a', 'b', 'c(1)')"), one).collect()}
    assert got == {"a": "aX40", "b": "bX1", "c(1)": "c(1)X1"}


def test_sections_and_repairs(spark):
    text = "(sect_nov_B_C_1:1,(Aus_bus_2,sect_nov_A),x_sect_nov_Z);"
    assert spark.range(1).select(P.strip_after_underscore(F.lit(text))).first()[0] == "(sect_nov_B:1,(Aus,sect_nov_A),x);"
    rows = {"(a,b):0;": "(a,b);", "(a,b)97:0;": "(a,b)97;", "(a,b):1.5e-10;": "(a,b);", "(a,b)\x07": "(a,b);", " ": ""}
    df = spark.createDataFrame(list(rows.items()), "t string, want string")
    assert all(r[0] == r.want for r in df.select(P.repair_tree("t"), "want").collect())


def test_longest_prefix(spark):
    genes = spark.createDataFrame([("Aus_bus_x_1",), ("Aus_1",), ("plain",), ("other_1",)], "gene string")
    species = spark.createDataFrame([("Aus",), ("Aus_bus",)], "species string")
    assert {r.gene: r.species for r in P.gene_species(genes, species).collect()} == {"Aus_bus_x_1": "Aus_bus", "Aus_1": "Aus", "plain": None, "other_1": None}


def test_texts_in_names_by_rare_pieces(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(120)] + ["xyz%_", "Q\\E.", "aQ\\E.b"]
    parts = names[:60] + ["a", "é", "ab", "zz", "", "%_", "\\E"]
    got = P.containing(spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame([(x,) for x in names], "other string"))
    assert sorted((r.part, r.other) for r in got.collect()) == sorted({(a, b) for a in parts for b in names if a and a in b})
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_genus_prefixes(spark):
    names = [("m", f"Brachy{x}") for x in ("pinn", "sylv", "dist", "other")] + [("few", f"Gen{x}") for x in ("pinn", "x", "y")] + [("plain", "pinn"), ("plain", "Genpinn"), ("one", "Genpinn")] + [("two", f"{p}{x}") for p, x in (("Genus", "pinn"), ("Genus", "sylv"), ("Genera", "dist"))]
    canonical = spark.createDataFrame([(x,) for x in ("pinn", "sylv", "dist")], "name string")
    got = {r.method: (r.prefix, r.names, r.support, r.matches) for r in P.genus_prefixes(spark.createDataFrame(names, "method string, name string"), canonical).collect()}
    assert got == {"m": ("Brachy", 4, 4, 3), "two": ("Genus", 3, 2, 2)}
    mapped = {r.name: r.canonical for r in P.harmonise(spark.createDataFrame([(n,) for m, n in names if m == "m"], "name string"), canonical).collect()}
    assert mapped == {"Brachypinn": "pinn", "Brachysylv": "sylv", "Brachydist": "dist"}


def test_counts_that_meet(spark):
    counts = spark.createDataFrame([("a1", 2), ("a2", 3), ("b", 5)], "taxon string, n long")
    names = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("c", "b")], "taxon string, name string")
    assert {r.taxon: r.n for r in P.merge_counts(counts, names).collect()} == {"a": 5, "b": 5}
