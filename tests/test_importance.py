import random

from cladeframe.operators import labels as L
from cladeframe.plans import label_queries  # noqa: F401
from cladeframe import registry


def test_importance_of_every_feature(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(400)]
    df = spark.createDataFrame([(i, x, int(x[5] + 0.2 * x[2] > 0)) for i, x in rows], "key long, features array<double>, label int")
    got = {r.feature: r for r in L.permutation_importance(df).collect()}
    assert set(got) == {str(i) for i in range(7)}
    assert got["5"].drop > 0.3 and got["5"].drop == max(r.drop for r in got.values())
    assert all(abs(got[str(i)].drop) < 0.05 for i in (0, 1, 3, 4, 6))
    one = {r.feature: r.f1 for r in L.permutation_importance(df, [5, 2], repeats=1).collect()}
    assert set(one) == {"5", "2"} and abs(one["5"] - got["5"].f1) < 0.15


def test_query_scores_all_dimensions(spark):
    got = registry.queries()["m4_permutation_importance"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(int(r.feature) for r in got) == list(range(64))


def test_feature_importances(spark):
    rng = random.Random(1)
    rows = [([float(y) + rng.gauss(0, 0.3), rng.gauss(0, 5), 1.0], y) for y in (0, 1) for _ in range(200)]
    found = {}
    for r in L.feature_importances(spark.createDataFrame(rows, "features array<double>, label int")).collect():
        found.setdefault(r.model, {})[r.feature] = r.importance
    assert set(found) == {"logistic", "forest", "boosted"}
    assert all(x[0] > 0.8 and x[2] == 0 and abs(sum(x.values()) - 1) < 1e-9 for x in found.values())
