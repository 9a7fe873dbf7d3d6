"""Greedy choices with a scope are those without."""

from pyspark.sql import functions as F

from cladeframe.operators.greedy import greedy


def test_scoped_choices_are_the_same(spark):
    """Trees that need one round and trees whose items wait for each other in a chain."""
    pairs = [(t, a, b, 1.0 / (1 + a + b)) for t in range(6) for a in range(1 + t) for b in (a, a + 1)]
    rows = spark.createDataFrame([(*p, e, p[1] if e == "a" else p[2]) for p in pairs for e in "ab"], "tree_id long, a long, b long, score double, end string, of long")
    args = (rows, ["tree_id", "a", "b"], ["tree_id", "end", "of"], [F.desc("score"), F.col("a"), F.col("b")], F.lit(1))
    whole, scoped = (sorted(map(tuple, d.collect())) for d in (greedy(*args), greedy(*args, ["tree_id"])))
    assert whole == scoped and len(whole) == 2 * sum(1 + t for t in range(6))
