"""What larger tables met first: counts whose products pass a long, and tasks that hold more the larger the table is."""

import os

import pytest
from pyspark.sql import functions as F

from cladeframe import registry
from cladeframe.operators.features import clade_summaries, flag_correlation
from cladeframe.plans import views

SF = "/root/testdata/sf0.001"


def test_flag_correlation_of_many_trees(spark):
    row = spark.createDataFrame([(420_000, 210_000, 210_000, 210_000), (420_000, 210_000, 210_000, 0), (4, 2, 2, 1)], "t long, s1 long, s2 long, both long")
    assert [round(x[0], 9) for x in row.select(flag_correlation(*(F.col(c) for c in row.columns))).collect()] == [1.0, -1.0, 0.0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_trees_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    query = registry.queries()["f12_clade_summaries"]
    rows = lambda: sorted(map(tuple, query(spark, SF).collect()))
    want, items = rows(), views.Views(spark, SF).lineitem.count()
    for most in (500, 250):
        monkeypatch.setattr(views, "ROWS_A_TASK", most)
        for name in ("v_leaves", "v_priced", "v_named_priced"):
            held = [r["count"] for r in getattr(views.Views(spark, SF), name).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(held) == items and max(held) < 2 * most
        got = rows()
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [x for r in got for x in r[2:]] == pytest.approx([x for r in want for x in r[2:]], abs=2e-6)


def test_clade_summaries_join_trees_once(spark):
    """Trees joined with the clades' sizes were shuffled by clade, into as many tasks as there are clades."""
    leaves = spark.createDataFrame([(0, 1, "a"), (0, 1, "a"), (0, 1, "b"), (0, 1, "c"), (0, 2, "b")], "sample_id long, tree_id long, species string")
    clades = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "x"), ("c", "y")], "species string, clade string")
    got = clade_summaries(leaves, clades)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    x, y = sorted(got.collect())
    assert (x.duplication, x.extra, x.per_species, x.coherence, x.in_out) == (0.5, 0.5, 1.25, 0.25, 1.5)
    assert x.variation == pytest.approx((1 + 3**0.5) / 2)
    assert (y.clade, y.per_species, y.in_out, y.variation) == ("y", 1.0, pytest.approx(2 / 3), None)
