"""Event labels on species-tree edges, their audits, and the evaluation of edge scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .greedy import greedy
from .lineage import cut


def event_problems(events: DataFrame) -> DataFrame:
    """Events with what is wrong with them, or null: empty target, allo without partner, unknown type."""
    none = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    return events.withColumn("problem", F.when(~F.col("event_type").isin("auto", "allo") | F.col("event_type").isNull(), "unknown type").when(none("target_clade"), "empty target").when((F.col("event_type") == "allo") & none("partner_clade"), "no partner"))


def map_to_edges(clades: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """The edge whose species are most like a clade's by Jaccard similarity (the lowest edge on ties): ``clade_id, edge, jaccard, mappable``.

    ``clades`` is ``clade_id, species`` and ``edges`` ``edge, species``. Overlaps come from counts of
    shared species.
    """
    a = clades.groupBy("clade_id").agg(F.count("*").alias("na"))
    b = edges.groupBy("edge").agg(F.count("*").alias("nb"))
    shared = clades.join(edges, "species").groupBy("clade_id", "edge").agg(F.count("*").alias("k"))
    scored = shared.join(a, "clade_id").join(b, "edge").withColumn("jaccard", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    best = scored.groupBy("clade_id").agg(F.min_by(F.struct("edge", "jaccard"), F.struct(-F.col("jaccard"), "edge")).alias("m"))
    return best.select("clade_id", "m.edge", "m.jaccard", (F.col("m.jaccard") >= least).alias("mappable"))


def home_edges(clades: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest edge that strictly holds a clade (the lowest on ties): ``clade_id, home``."""
    a = clades.groupBy("clade_id").agg(F.count("*").alias("na"))
    b = edges.groupBy("edge").agg(F.count("*").alias("nb"))
    shared = clades.join(edges, "species").groupBy("clade_id", "edge").agg(F.count("*").alias("k"))
    held = shared.join(a, "clade_id").join(b, "edge").filter("k = na and nb > na")
    return held.groupBy("clade_id").agg(F.min_by("edge", F.struct("nb", "edge")).alias("home"))


def event_composition(events: DataFrame) -> DataFrame:
    """Events by type and number of target species, with their share of the sample's events."""
    found = events.groupBy("sample_id", "event_type", "size").agg(F.count("*").alias("n"))
    return found.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("sample_id")))


def dropped_rate(events: DataFrame) -> DataFrame:
    """Per config: events, those without a mappable edge, and their share."""
    return events.groupBy("config").agg(F.count("*").alias("events"), F.count(F.when(~F.col("mappable"), 1)).alias("dropped"), F.avg((~F.col("mappable")).cast("double")).alias("rate"))


def compare_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per sample: labels in both, detections that agree, allo partners that changed, and the mappable share of the new ones."""
    a = old.select("sample_id", "event_ix", F.col("edge").alias("edge_a"), F.col("partner").alias("partner_a"))
    b = new.select("sample_id", "event_ix", "event_type", F.col("edge").alias("edge_b"), F.col("partner").alias("partner_b"), "mappable")
    n = lambda c: F.count(F.when(c, 1))
    both = a.join(b, ["sample_id", "event_ix"], "full")
    return both.groupBy("sample_id").agg(n(F.col("edge_a").isNotNull() & F.col("edge_b").isNotNull()).alias("both"), n(F.col("edge_a") == F.col("edge_b")).alias("same_edge"), n((F.col("event_type") == "allo") & (F.col("partner_a") != F.col("partner_b"))).alias("partner_changed"), F.avg(F.col("mappable").cast("double")).alias("mappable"))


def class_statistics(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean, std and median of each feature by class, with the class's size."""
    long = rows.select(F.col(label).alias("label"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["label"], list(columns), "feature", "x")
    return long.groupBy("label", "feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.median("x").alias("median"))


def binned_sizes(sizes: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """Counts and shares by bins of ``size``: up to each bound, then over the last."""
    bin_ = F.lit(f"> {bounds[-1]}")
    for b in reversed(bounds):
        bin_ = F.when(F.col("size") <= b, f"<= {b}").otherwise(bin_)
    found = sizes.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    return found.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """True and false positives and false negatives, precision, recall and F1 (0 where undefined) at each threshold.

    Scores are first counted per interval between thresholds, so the grid meets a few rows per key
    and not every edge.
    """
    grid = sorted(thresholds)
    at = F.lit(0)
    for t in grid:
        at = at + (F.col("prob") >= t).cast("int")
    binned = scores.groupBy(*keys, at.alias("at")).agg(F.sum((F.col("target") == 1).cast("long")).alias("pos"), F.sum((F.col("target") != 1).cast("long")).alias("neg"))
    every = binned.select(*keys, "at", "pos", "neg", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)))).alias("g"))
    over = F.col("at") >= F.col("g.i")
    s = every.groupBy(*keys, "g.threshold").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(over, 0).otherwise(F.col("pos"))).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The threshold of the best F1, the first on ties."""
    return sweep.groupBy(*keys).agg(F.min_by(F.struct("threshold", "f1"), F.struct(-F.round("f1", 9), "threshold")).alias("b")).select(*keys, "b.threshold", "b.f1")


def error_budget(scores: DataFrame, threshold: float) -> DataFrame:
    """Per config: precision, recall and F1 of edges at a threshold, and the mean error of the number of events per sample."""
    hit, true = F.col("prob") >= threshold, F.col("target") == 1
    n = lambda c: F.count(F.when(c, 1))
    per = scores.groupBy("config", "sample_id").agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return per.groupBy("config").agg(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.avg(F.abs(F.col("fp") - F.col("fn"))).alias("count_error"))


def select_edges(candidates: DataFrame, strategy: str, threshold: float) -> DataFrame:
    """Edges that become events: ``sample_id, edge_ix``.

    ``candidates`` has ``sample_id, edge_ix, prob, species`` and ``bound``, one row per species of an
    edge's clade. ``detect_only`` takes what is at least as probable as the threshold. The others take
    edges by falling probability (ties by number) unless a species would pass its bound of copies:
    ``cap`` among those over the threshold, ``bound_driven`` among all, ``detect`` all and then any
    other over the threshold. The greedy choice is made in rounds (see `greedy`).
    """
    if strategy == "detect_only":
        return candidates.filter(F.col("prob") >= threshold).select("sample_id", "edge_ix").distinct()
    if strategy not in ("cap", "bound_driven", "detect"):
        raise ValueError(f"unknown strategy {strategy!r}")
    sure = F.col("prob") >= threshold
    rows = candidates.filter(sure) if strategy == "cap" else candidates
    chosen = greedy(rows, ["sample_id", "edge_ix"], ["sample_id", "species"], [F.desc("prob"), F.col("edge_ix")], F.col("bound") - 1).select("sample_id", "edge_ix")
    if strategy == "detect":
        chosen = chosen.unionByName(candidates.filter(sure).select("sample_id", "edge_ix"))
    return chosen.distinct()


RELATIONS = ("parent", "child", "sibling", "ancestor", "descendant", "scattered")


def false_positive_relations(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """How each false positive lies to the true edges of its sample; the first relation of `RELATIONS` that holds counts.

    ``edges`` is ``sample_id, edge, parent, hit, target``. ``members`` (``edge, species``) tells which
    edges hold others; without it there are no ancestors and descendants.
    """
    fp = edges.filter("hit and target = 0").select("sample_id", "edge", "parent")
    true = edges.filter("target = 1").select("sample_id", F.col("edge").alias("t"), F.col("parent").alias("tp")).filter("t is not null")
    pairs = fp.join(true, "sample_id")
    inside = F.lit(5)
    if members is not None:
        sized = members.withColumn("n", F.count("*").over(W.partitionBy("edge")))
        other = sized.select(F.col("edge").alias("t"), "species", F.col("n").alias("m"))
        shared = sized.join(other, "species").groupBy("edge", "t").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("m").alias("m"))
        nested = shared.filter("n <> m and (k = n or k = m)").select("edge", "t", F.when(F.col("n") > F.col("m"), 3).otherwise(4).alias("nested"))
        pairs, inside = pairs.join(nested, ["edge", "t"], "left"), F.coalesce("nested", F.lit(5))
    rank = F.when(F.col("tp") == F.col("edge"), 0).when(F.col("parent") == F.col("t"), 1).when(F.col("parent") == F.col("tp"), 2).otherwise(inside)
    least = pairs.groupBy("sample_id", "edge").agg(F.min(rank).alias("rank"))
    names = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("rank") + 1)
    return fp.join(least, ["sample_id", "edge"], "left").select("sample_id", "edge", F.when(F.col("rank").isNull(), "no true edge").otherwise(names).alias("relation"))


def partner_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right partners of auto events (partner is the edge) and of others, per config: ``config, auto, auto_accuracy, allo, allo_accuracy`` (0 where there is none)."""
    auto, right = F.col("partner") == F.col("edge"), F.col("predicted") == F.col("partner")
    n = lambda c: F.count(F.when(c, 1))
    rate = lambda c: F.coalesce(F.try_divide(n(c & right), n(c)), F.lit(0.0))
    return predictions.groupBy("config").agg(n(auto).alias("auto"), rate(auto).alias("auto_accuracy"), n(~auto).alias("allo"), rate(~auto).alias("allo_accuracy"))


def partner_summary(predictions: DataFrame, tips: DataFrame) -> DataFrame:
    """Per sample: predictions, the share whose partner is a tip (``tips``: edge), and pairs of edges that point at each other."""
    back = predictions.select("sample_id", F.col("edge").alias("predicted"), F.col("predicted").alias("returned"))
    rows = predictions.join(tips.select(F.col("edge").alias("predicted"), F.lit(1).alias("tip")), "predicted", "left").join(back, ["sample_id", "predicted"], "left")
    pair = (F.col("returned") == F.col("edge")) & (F.col("edge") <= F.col("predicted"))
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), (F.count("tip") / F.count("*")).alias("tip_share"), F.count(F.when(pair, 1)).alias("reciprocal"))


def scores_by_tag(samples: DataFrame) -> DataFrame:
    """Scores of samples with a tag and without: ``tag, n, mean, median, gap`` (the mean with it less that without; null where all have it).

    ``samples`` is ``sample_id, score, tags`` (an array).
    """
    whole = samples.agg(F.sum("score").alias("every"), F.count("score").alias("all"))
    per = samples.select("score", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.sum("score").alias("own"))
    return per.join(F.broadcast(whole)).select("tag", "n", "mean", "median", (F.col("mean") - F.try_divide(F.col("every") - F.col("own"), F.col("all") - F.col("n"))).alias("gap"))


def edge_classifiers(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Precision, recall and F1 of balanced logistic regression, random forest and boosted trees on held-out rows: ``model, precision, recall, f1``.

    ``rows`` is ``key, features (array), label``; a fifth of the keys, by hash, is held out.
    """
    held = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    rows = rows.select("key", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    train, test = rows.filter(~held), rows.filter(held)
    ones = train.agg(F.avg("label")).first()[0] or 0.5
    train = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(ones, 1e-9)).otherwise(0.5 / max(1 - ones, 1e-9)))
    models = {"logistic": LogisticRegression(weightCol="weight", regParam=0.01), "forest": RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=4, seed=seed), "boosted": GBTClassifier(weightCol="weight", maxIter=5, maxDepth=3, seed=seed)}
    out = None
    for name, model in models.items():
        scored = model.fit(train).transform(test).select(F.lit(name).alias("model"), vector_to_array("probability")[1].alias("prob"), F.col("label").cast("int").alias("target"))
        out = scored if out is None else out.unionByName(scored)
    return threshold_sweep(out, [0.5], ["model"]).select("model", "precision", "recall", "f1")


def feature_importances(rows: DataFrame, seed: int = 1) -> DataFrame:
    """How much each feature counts in the models of `edge_classifiers`, fitted on all rows: ``model, feature, importance``.

    The impurity that forest and boosted trees lose by it, or the size of its coefficient in units of the feature's deviation; each model's sum to 1.
    ``rows`` is ``features (array), label``. Only the models' own vectors reach the driver.
    """
    data = rows.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    width = len(data.first()["features"])
    deviation = rows.select(*(F.stddev_pop(F.col("features")[i].cast("double")) for i in range(width))).first()
    found = {
        "logistic": [abs(c) * (d or 0.0) for c, d in zip(LogisticRegression(regParam=0.01).fit(data).coefficients, deviation)],
        "forest": RandomForestClassifier(numTrees=20, maxDepth=4, seed=seed).fit(data).featureImportances.toArray().tolist(),
        "boosted": GBTClassifier(maxIter=5, maxDepth=3, seed=seed).fit(data).featureImportances.toArray().tolist(),
    }
    scaled = [(m, i, float(v / (sum(vs) or 1.0))) for m, vs in found.items() for i, v in enumerate(vs)]
    return rows.sparkSession.createDataFrame(scaled, "model string, feature int, importance double")


def permutation_importance(rows: DataFrame, features: Sequence[int] | None = None, repeats: int = 5, seed: int = 1) -> DataFrame:
    """How much F1 falls when one feature is shuffled over all rows, averaged over repeats: ``feature, f1, drop``.

    All features of the vector, or those named. Each repeat holds two hash orders of the rows, joined on
    their ranks, that give each row the values of another; as in the reference a repeat's order serves
    every feature. Ranks come from a range partition and an offset per partition, so no task sorts all
    rows. The model is linear, so a shuffled feature moves the row's margin by its coefficient.
    """
    keyed = rows.select("key", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(regParam=0.01).fit(keyed.select(array_to_vector("features").alias("features"), "label"))
    weights = F.array(*(F.lit(float(w)) for w in model.coefficients))
    margin = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda a, b: a + b)
    keyed = keyed.select("key", "features", margin.alias("margin"), F.col("label").cast("int").alias("target"))

    def prob(m):
        return (1 / (1 + F.exp(-m))).alias("prob")

    def ranked(columns: list[str], salt: int) -> DataFrame:
        dealt = keyed.select(F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), "key", *columns).withColumn("h", F.xxhash64("key", "repeat", F.lit(salt)))
        dealt = cut(dealt.repartitionByRange("repeat", "h").withColumn("p", F.spark_partition_id()), "dealt")
        counts = dealt.groupBy("repeat", "p").count()
        before = counts.select("repeat", "p", (F.sum("count").over(W.partitionBy("repeat").orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("before"))
        own = F.row_number().over(W.partitionBy("repeat", "p").orderBy("h", "key"))
        return dealt.withColumn("k", own).join(F.broadcast(before), ["repeat", "p"]).select("repeat", *columns, (F.col("k") + F.col("before")).alias("rank"))

    other = ranked(["features"], seed + 1).withColumnRenamed("features", "others")
    mixed = ranked(["features", "margin", "target"], seed).join(other, ["repeat", "rank"])
    moved = F.zip_with(F.zip_with("others", "features", lambda o, x: o - x), weights, lambda d, w: d * w)
    long = mixed.select("repeat", "margin", "target", F.posexplode(moved).alias("feature", "move"))
    if features is not None:
        long = long.filter(F.col("feature").isin(list(features)))
    scored = long.select(F.col("feature").cast("string").alias("feature"), "repeat", prob(F.col("margin") + F.col("move")), "target")
    each = threshold_sweep(scored, [0.5], ["feature", "repeat"]).groupBy("feature").agg(F.avg("f1").alias("f1"))
    base = threshold_sweep(keyed.select(prob(F.col("margin")), "target"), [0.5]).select(F.col("f1").alias("base"))
    return each.crossJoin(F.broadcast(base)).select("feature", "f1", (F.col("base") - F.col("f1")).alias("drop"))


def detection_by_outcome(scores: DataFrame) -> DataFrame:
    """Quartiles of a species' best score, and the share of 0.5 or more, by whether it was caught, missed or is diploid.

    ``scores`` is ``sample_id, species, prob, polyploid, predicted``.
    """
    best = scores.groupBy("sample_id", "species").agg(F.max("prob").alias("prob"), F.max("polyploid").alias("polyploid"), F.max("predicted").alias("predicted"))
    outcome = F.when(~F.col("polyploid"), "diploid").when(F.col("predicted"), "caught").otherwise("missed")
    return best.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), *(F.percentile("prob", q).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.avg((F.col("prob") >= 0.5).cast("double")).alias("sure"))


def partner_errors(predictions: DataFrame) -> DataFrame:
    """Wrong partners by kind, per sample: self, reciprocal, near (the clades of the true and the predicted partner share a species) or far.

    ``predictions`` is ``sample_id, edge, partner, predicted`` and the arrays ``clade, predicted_clade``, an edge a row in its sample.
    """
    back = predictions.select("sample_id", F.col("edge").alias("predicted"), F.col("predicted").alias("returned"))
    near = F.coalesce(F.arrays_overlap("clade", "predicted_clade"), F.lit(False))
    kind = F.when(F.col("predicted") == F.col("edge"), "self").when(F.col("returned") == F.col("edge"), "reciprocal").when(near, "near").otherwise("far")
    return predictions.filter("predicted <> partner").join(back, ["sample_id", "predicted"], "left").groupBy("sample_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bounds: Sequence[float] | None = None) -> DataFrame:
    """How many rows fall in each bin of a column, and their share: ``measure, bin, n, share``.

    A bin holds what is over the bound before and no more than its own, and the last what is over all; without bounds each
    value is one. Nulls are not counted.
    """
    x = F.col(column)
    label = x.cast("string")
    if bounds is not None:
        label = F.lit(f"> {bounds[-1]:g}")
        for bound in reversed(bounds):
            label = F.when(x <= bound, f"<= {bound:g}").otherwise(label)
    rows = df.filter(x.isNotNull())
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(label.alias("bin")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(F.lit(column).alias("measure"), "bin", "n", (F.col("n") / F.col("total")).alias("share"))


def corpus_totals(samples: DataFrame, measures: Sequence[str] = ("n_species", "n_leaves")) -> DataFrame:
    """One row on a training corpus: samples, those without an applied event, events requested and applied, the share applied (null without requests), and least, greatest and mean of each measure."""
    none = F.count(F.when(F.coalesce("applied", F.lit(0)) == 0, 1)).alias("without_events")
    shape = [f(m).alias(f"{m}_{k}") for m in measures for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    found = samples.agg(F.count("*").alias("samples"), none, F.sum("requested").alias("requested"), F.sum("applied").alias("applied"), *shape)
    return found.withColumn("success", F.try_divide("applied", "requested"))

