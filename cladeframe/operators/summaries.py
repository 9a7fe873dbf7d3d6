"""Summaries of the long metric table ``network, config, method, replicate, metric, value, status``.

A run that failed has status FAILED and a null value; nulls never count. ``std`` is the sample
standard deviation unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUCCESS = "status = 'SUCCESS'"


def aggregate_replicates(df: DataFrame, keys: Sequence[str] = ("network", "config", "method", "metric")) -> DataFrame:
    """Mean, std (0 where one value has none), min, max and count of the values of successful runs."""
    v = F.col("value")
    return df.filter(SUCCESS).groupBy(*keys).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n_valid"))


def pivot_methods(aggregated: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("network", "config", "metric")) -> DataFrame:
    """A row per key with ``<method>_mean, _std, _n`` and the text ``mean ± std (n)``; the method list spares a pass to find them."""
    text = F.format_string("%.6f ± %.6f (%d)", F.col("mean"), F.col("std"), F.col("n_valid"))
    wide = aggregated.filter("n_valid > 0").groupBy(*keys).pivot("method", list(methods)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("n_valid").alias("n"), F.first(text).alias("text"))
    return wide


def rank_methods(aggregated: DataFrame) -> DataFrame:
    """Methods ranked by position within each metric and network (ties by name): mean value, mean rank, times best and worst."""
    w = W.partitionBy("config", "metric", "network")
    ranked = aggregated.filter("mean is not null").withColumns({"rank": F.row_number().over(w.orderBy("mean", "method")), "last": F.count("*").over(w)})
    return ranked.groupBy("config", "metric", "method").agg(F.avg("mean").alias("mean_value"), F.avg("rank").alias("mean_rank"), F.sum((F.col("rank") == 1).cast("long")).alias("times_best"), F.sum((F.col("rank") == F.col("last")).cast("long")).alias("times_worst"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def property_correlations(aggregated: DataFrame, stats: DataFrame, properties: Sequence[str], keys: Sequence[str] = ("config", "metric", "method"), least: int = 3) -> DataFrame:
    """Pearson correlation of network properties with mean error over networks, where at least ``least`` networks have both."""
    long = stats.unpivot("network", list(properties), "property", "x").filter("x is not null")
    return aggregated.filter("mean is not null").join(long, "network").groupBy(*keys, "property").agg(F.count("*").alias("n"), correlation(F.col("x").cast("double"), F.col("mean")).alias("r")).filter(F.col("n") >= least)


def with_p_values(correlations: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds the two-sided p-value of each correlation (Student's t with n - 2 degrees) and whether it is under ``level``; null under 3 values."""
    p = F.when(F.col("n") > 2, incomplete_beta((F.col("n") - 2) / 2, 1 - F.col("r") * F.col("r")))
    return correlations.withColumn("p", p).withColumn("significant", F.col("p") < level)


def incomplete_beta(a: Column, x: Column, rounds: int = 200) -> Column:
    """The regularised incomplete beta function I_x(a, 1/2) as a column; ``a`` is a positive multiple of 1/2.

    Beta(a, 1/2) follows from Beta(1/2, 1/2) = pi or Beta(1, 1/2) = 2 by a -> a + 1. The continued
    fraction is evaluated forwards on the side of its peak where it is quick, for ``rounds`` pairs of
    terms, which is enough for a in the tens of thousands.
    """
    whole = F.pmod(2 * a, F.lit(2)) == 0
    start = F.when(whole, F.lit(1.0)).otherwise(0.5)
    steps = F.round(a - start).cast("int")
    ups = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    log_beta = F.aggregate(ups, F.when(whole, F.log(F.lit(2.0))).otherwise(F.log(F.pi())), lambda s, i: s + F.log((start + i) / (start + i + 0.5)))
    b = F.lit(0.5)
    near = x < (a + 1) / (a + b + 2)
    front = F.exp(a * F.log(x) + b * F.log(1 - x) - log_beta)
    lower, upper = _beta_fraction(a, b, x, rounds), _beta_fraction(b, a, 1 - x, rounds)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(near, front * lower / a).otherwise(1 - front * upper / b)


def _beta_fraction(a: Column, b: Column, x: Column, rounds: int) -> Column:
    """The continued fraction of the incomplete beta function: ratios of neighbouring convergents, never zero, multiplied up."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def term(s: Column, t: Column) -> Column:
        d = 1 / safe(1 + t * s["d"])
        c = safe(1 + t / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    terms = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda m: F.array(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))))
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(terms, begin, term, lambda s: s["h"])


def _order(thresholds: Sequence[str], column: str = "method") -> Column:
    return F.element_at(F.create_map(*(x for i, m in enumerate(thresholds) for x in (F.lit(m), F.lit(i)))), F.col(column))


def collapse_threshold_inventory(inventory: DataFrame, thresholds: Sequence[str], label: str) -> DataFrame:
    """One row per run for methods that differ by a threshold: the lowest that completed, else the first."""
    of = F.col("method").isin(*thresholds)
    w = W.partitionBy("network", "config", "replicate").orderBy(F.col("inferred_exists").desc(), _order(thresholds))
    picked = inventory.filter(of).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumn("method", F.lit(label))
    return inventory.filter(~of).unionByName(picked)


def collapse_threshold_comparisons(df: DataFrame, thresholds: Sequence[str], label: str) -> DataFrame:
    """Keeps all rows of the lowest threshold with a success in each run; a run without one goes."""
    of = F.col("method").isin(*thresholds)
    ordered = df.filter(of).withColumn("at", _order(thresholds))
    least = ordered.filter(SUCCESS).groupBy("network", "config", "replicate").agg(F.min("at").alias("at"))
    return df.filter(~of).unionByName(ordered.join(least, ["network", "config", "replicate", "at"]).drop("at").select(df.columns).withColumn("method", F.lit(label)))


def bias_to_percent(df: DataFrame, stats: DataFrame, metric, truth: str = "total_wgd") -> DataFrame:
    """Values of one metric as percent of the true events; unchanged where the truth is 0 or unknown."""
    t = F.col(truth)
    return df.join(stats.select("network", truth), "network", "left").withColumn("value", F.when((F.col("metric") == metric) & (t > 0), F.col("value") / t * 100).otherwise(F.col("value"))).drop(truth)


def completion(inventory: DataFrame, configs: Sequence, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Percent of completed runs, one column per config, 0 where there is none."""
    return inventory.groupBy(*keys).pivot("config", list(configs)).agg(F.avg(F.col("inferred_exists").cast("double")) * 100).na.fill(0.0)


def config_summary(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Mean, std and count per method, config and metric with the completion percent."""
    done = inventory.groupBy("method", "config").agg((F.avg(F.col("inferred_exists").cast("double")) * 100).alias("completion"))
    found = df.filter(SUCCESS).groupBy("method", "config", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
    return found.join(done, ["method", "config"], "left")


def average_ranks(summary: DataFrame, groups: Sequence[str] = ("config", "metric")) -> DataFrame:
    """Ranks by mean with shared averages for ties and nulls last; then the mean rank of each method."""
    w = W.partitionBy(*groups).orderBy(F.col("mean").asc_nulls_last())
    peers = F.count("*").over(W.partitionBy(*groups, "mean"))
    return summary.withColumn("rank", F.rank().over(w) + (peers - 1) / 2).groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def ranks_with_completion(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Mean rank of each method over all metrics and completion: ``method, mean_rank, completion_rank, measures``.

    A metric ranks the methods by their mean over all successful runs, completion by the percent of completed
    runs, the most first. Ties share the average of their ranks; a method without a value is last.
    Means are compared at 9 places.
    """
    name = F.col("metric").cast("string").alias("metric")
    means = df.filter(SUCCESS).groupBy("method", name).agg(F.round(F.avg("value"), 9).alias("value")).filter("value is not null")
    done = inventory.groupBy("method").agg((F.avg(F.col("inferred_exists").cast("double")) * -100).alias("value")).select("method", F.lit("completion").alias("metric"), F.round("value", 9).alias("value"))
    found = means.unionByName(done)
    grid = found.select("method").distinct().crossJoin(found.select("metric").distinct())  # methods by metrics
    w = W.partitionBy("metric").orderBy(F.col("value").asc_nulls_last())
    peers = F.count("*").over(W.partitionBy("metric", "value"))
    ranked = grid.join(found, ["method", "metric"], "left").withColumn("rank", F.rank().over(w) + (peers - 1) / 2)
    return ranked.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.max(F.when(F.col("metric") == "completion", F.col("rank"))).alias("completion_rank"), F.count("*").alias("measures"))


def error_by_complexity(df: DataFrame, stats: DataFrame, prop: str) -> DataFrame:
    """Networks split at the median of a property; mean error per level."""
    middle = stats.agg(F.percentile(prop, 0.5).alias("middle"))
    level = stats.crossJoin(F.broadcast(middle)).select("network", F.when(F.col(prop) <= F.col("middle"), "low").otherwise("high").alias("level"))
    return df.filter(SUCCESS).join(level, "network").groupBy("method", "metric", "level").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def completion_by_property(inventory: DataFrame, stats: DataFrame, prop: str) -> DataFrame:
    """Completion per network, then mean and standard error (population) per property value and method."""
    per = inventory.groupBy("network", "method").agg(F.avg(F.col("inferred_exists").cast("double")).alias("rate"))
    return per.join(stats.select("network", prop), "network").groupBy("method", prop).agg(F.avg("rate").alias("mean"), (F.stddev_pop("rate") / F.sqrt(F.count("*"))).alias("se"))


def error_by_property(df: DataFrame, stats: DataFrame, prop: str) -> DataFrame:
    """Error per network, then mean and standard error (sample) per property value, method and metric."""
    per = df.filter(SUCCESS).groupBy("network", "method", "metric").agg(F.avg("value").alias("error"))
    return per.join(stats.select("network", prop), "network").groupBy("method", "metric", prop).agg(F.avg("error").alias("mean"), (F.stddev_samp("error") / F.sqrt(F.count("*"))).alias("se"))


def detection_scores(aggregated: DataFrame, tp, fp, fn, keys: Sequence[str] = ("config", "method")) -> DataFrame:
    """Precision, recall and F1 from the summed means of the three count metrics; null where undefined."""
    total = lambda m: F.sum(F.when(F.col("metric") == m, F.col("mean")))
    s = aggregated.groupBy(*keys).agg(total(tp).alias("tp"), total(fp).alias("fp"), total(fn).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp_, fp_, fn_ = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*keys, ratio(tp_, tp_ + fp_).alias("precision"), ratio(tp_, tp_ + fn_).alias("recall"), ratio(2 * tp_, 2 * tp_ + fp_ + fn_).alias("f1"))


def correlation_matrix(df: DataFrame, stats: DataFrame, properties: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of each property with each metric over network means, overall or per key."""
    per = df.filter(SUCCESS).groupBy("network", *keys, "metric").agg(F.avg("value").alias("mean"))
    long = stats.unpivot("network", list(properties), "property", "x")
    return per.join(long, "network").groupBy(*keys, "property", "metric").agg(correlation(F.col("x").cast("double"), F.col("mean")).alias("r"), F.count("*").alias("n"))


def method_performance(df: DataFrame, inventory: DataFrame, error, bias) -> DataFrame:
    """Runs, completed, rate; mean, median and std of network means; mean absolute error and bias."""
    runs = inventory.groupBy("method").agg(F.count("*").alias("runs"), F.sum(F.col("inferred_exists").cast("long")).alias("completed"), F.avg(F.col("inferred_exists").cast("double")).alias("rate"))
    ok = df.filter(SUCCESS)
    per = ok.filter(F.col("metric") == error).groupBy("method", "network").agg(F.avg("value").alias("m")).groupBy("method").agg(F.avg("m").alias("mean"), F.median("m").alias("median"), F.stddev_samp("m").alias("std"))
    of = F.when(F.col("metric") == bias, F.col("value"))
    off = ok.groupBy("method").agg(F.avg(F.abs(of)).alias("mae"), F.avg(of).alias("bias"))
    return runs.join(per, "method", "left").join(off, "method", "left")


def network_table(df: DataFrame, inventory: DataFrame, methods: Sequence[str], metrics: Sequence) -> DataFrame:
    """A row per network with completion and error of each method; the error is the first metric of the list that has one."""
    done = inventory.groupBy("network").pivot("method", list(methods)).agg(F.avg(F.col("inferred_exists").cast("double")))
    errors = df.filter(SUCCESS).groupBy("network", "method").agg(F.coalesce(*(F.avg(F.when(F.col("metric") == m, F.col("value"))) for m in metrics)).alias("e")).groupBy("network").pivot("method", list(methods)).agg(F.first("e"))
    rename = lambda d, end: d.select("network", *(F.col(m).alias(f"{m}_{end}") for m in methods))
    return rename(done, "completion").join(rename(errors, "error"), "network", "left")


def master_frame(df: DataFrame, stats: DataFrame, levels: DataFrame) -> DataFrame:
    """Comparisons with network statistics, the config's level (Unknown if it has none) and a success flag."""
    return df.join(stats, "network", "left").join(levels, "config", "left").withColumns({"level": F.coalesce("level", F.lit("Unknown")), "success": F.expr(SUCCESS)})


def master_summary(master: DataFrame) -> DataFrame:
    return master.groupBy("method", "level", "metric").agg(F.count("*").alias("runs"), F.sum(F.col("success").cast("long")).alias("completed"), F.avg("value").alias("mean"), F.avg("num_species").alias("mean_species"))


def two_stage_mean(df: DataFrame, keys: Sequence[str] = ("config", "method", "metric")) -> DataFrame:
    """Replicate means per network, then mean and standard error of the mean over networks."""
    per = df.filter(SUCCESS).groupBy(*keys, "network").agg(F.avg("value").alias("m"))
    return per.groupBy(*keys).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n"))


def paired_test(df: DataFrame, first: str, second: str, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Two methods on the networks that both have: means, mean difference, and how often the first is lower, higher or equal."""
    per = df.filter(SUCCESS).groupBy(*keys, "network", "method").agg(F.avg("value").alias("m")).filter("m is not null")
    side = lambda m, name: per.filter(F.col("method") == m).select(*keys, "network", F.col("m").alias(name))
    d = F.col("a") - F.col("b")
    count = lambda c: F.sum(c.cast("long"))
    return side(first, "a").join(side(second, "b"), [*keys, "network"]).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("delta"), count(d < 0).alias("better"), count(d > 0).alias("worse"), count(d == 0).alias("tie"))


def like_for_like(df: DataFrame, reference: str, keys: Sequence[str] = ("network", "config", "replicate")) -> DataFrame:
    """All methods on the runs where the reference method succeeded: means, rows, and coverage of those runs in percent."""
    ok = df.filter(SUCCESS)
    held = ok.filter(F.col("method") == reference).select(*keys).distinct()
    total = held.agg(F.count("*").alias("total"))
    found = ok.join(held, list(keys), "left_semi").groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.count_distinct(*keys).alias("runs"))
    return found.crossJoin(F.broadcast(total)).select("method", "metric", "mean", "runs", (F.col("runs") / F.col("total") * 100).alias("coverage"))


def matched_copies(runs: DataFrame, reference: str, keys: Sequence[str] = ("network", "replicate")) -> DataFrame:
    """All methods on the runs where the reference method has the right copies: ``method, n, coverage, mean, copies_ok`` (percent).

    ``runs`` is the keys, ``method, value, copies_match``, the last as in `networks.copy_difference`.
    """
    held = runs.filter((F.col("method") == reference) & F.col("copies_match")).select(*keys).distinct()
    total = held.agg(F.count("*").alias("total"))
    found = runs.join(held, list(keys), "left_semi").groupBy("method").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.avg(F.col("copies_match").cast("double")) * 100).alias("copies_ok"))
    return found.crossJoin(F.broadcast(total)).select("method", "n", (F.col("n") / F.col("total") * 100).alias("coverage"), "mean", "copies_ok")


def pairs_wide(pairs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean distance per network and metric, a column ``<a>_vs_<b>`` per pair of methods."""
    columns = [f"{a}_vs_{b}" for i, a in enumerate(methods) for b in methods[i + 1 :]]
    named = pairs.withColumn("pair", F.concat_ws("_vs_", "method1", "method2"))
    return named.groupBy("network", "metric").pivot("pair", columns).agg(F.avg("value"))


def best_per_network(df: DataFrame) -> DataFrame:
    """The method with the least mean error on each network and metric (the first by name on ties): ``network, metric, method, mean, margin`` (to the next one; null where there is none)."""
    means = df.filter(SUCCESS).groupBy("network", "metric", "method").agg(F.avg("value").alias("mean")).filter("mean is not null")
    by = W.partitionBy("network", "metric").orderBy(F.round("mean", 9), "method")
    return means.withColumns({"k": F.row_number().over(by), "margin": F.lead("mean").over(by) - F.col("mean")}).filter("k = 1").drop("k")


def head_to_head(wide_scores: DataFrame, metrics: dict[str, str], method: str, rivals: DataFrame) -> DataFrame:
    """One long table from a wide score table (melted, metrics renamed) and a long one, replicates averaged, then ``<method>_<metric>`` columns by network."""
    names = F.create_map(*(F.lit(x) for kv in metrics.items() for x in kv))
    own = wide_scores.unpivot(["network"], list(metrics), "score", "value").select("network", F.lit(method).alias("method"), names[F.col("score")].alias("metric"), "value")
    both = own.unionByName(rivals.filter(SUCCESS).select("network", "method", F.col("metric").cast("string").alias("metric"), "value").filter(F.col("metric").isin(*metrics.values())))
    return both.filter("value is not null").groupBy("network", "method", "metric").agg(F.avg("value").alias("value"))


def common_subset(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Of two columns of a wide table: completion counts, means where both are known, and the mean of the first where the second failed or not."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    return wide.agg(F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.sum(both.cast("long")).alias("n_both"), F.avg(F.when(both, x)).alias("mean_a"), F.avg(F.when(both, y)).alias("mean_b"), F.avg(F.when(y.isNull(), x)).alias("mean_a_where_b_failed"), F.avg(F.when(y.isNotNull(), x)).alias("mean_a_where_b_completed"))


def average_numeric(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All numeric scores of a sample averaged over its rows."""
    return df.groupBy(key).agg(*(F.avg(c).alias(c) for c in columns))


def method_availability(inventory: DataFrame, comparable: DataFrame) -> DataFrame:
    """Per method: networks with a result, those among the comparable ones, and the share of these."""
    has = inventory.filter("inferred_exists").select("method", "network").distinct()
    total = comparable.agg(F.count("*").alias("total"))
    marked = has.join(F.broadcast(comparable.withColumn("ok", F.lit(1))), "network", "left")
    found = marked.groupBy("method").agg(F.count("*").alias("available"), F.count("ok").alias("comparable"))
    return found.crossJoin(F.broadcast(total)).select("method", "available", "comparable", (F.col("comparable") / F.nullif(F.col("total"), F.lit(0))).alias("share"))


def method_pairs(df: DataFrame, keys: Sequence[str] = ("network", "metric")) -> DataFrame:
    """Absolute difference of two methods' mean values per key, for each unordered pair."""
    per = df.filter(SUCCESS).groupBy(*keys, "method").agg(F.avg("value").alias("m")).filter("m is not null")
    a, b = per.withColumnRenamed("method", "method1").withColumnRenamed("m", "m1"), per.withColumnRenamed("method", "method2").withColumnRenamed("m", "m2")
    return a.join(b, list(keys)).filter("method1 < method2").select(*keys, "method1", "method2", F.abs(F.col("m1") - F.col("m2")).alias("value"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("method1", "method2", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def disagreement_ranks(pairs: DataFrame) -> DataFrame:
    """Methods by their mean distance to all others, on either side of a pair; ties share the least rank."""
    sides = pairs.select("metric", F.explode(F.array("method1", "method2")).alias("method"), "value")
    return sides.groupBy("metric", "method").agg(F.avg("value").alias("mean_distance")).withColumn("rank", F.rank().over(W.partitionBy("metric").orderBy("mean_distance")))


def distance_matrix(pairs: DataFrame, metric, methods: Sequence[str]) -> DataFrame:
    """The symmetric method x method table of mean distances, with a diagonal of 0."""
    own = pairs.filter(F.col("metric") == metric)
    flipped = own.select(F.col("method2").alias("method1"), F.col("method1").alias("method2"), "value")
    diagonal = own.select(F.explode(F.array(*map(F.lit, methods))).alias("method1")).distinct().select("method1", F.col("method1").alias("method2"), F.lit(0.0).alias("value"))
    return own.select("method1", "method2", "value").unionByName(flipped).unionByName(diagonal).groupBy(F.col("method1").alias("method")).pivot("method2", list(methods)).agg(F.avg("value"))


def network_disagreement(pairs: DataFrame) -> DataFrame:
    """Networks ranked by mean disagreement, overall and per metric."""
    found = pairs.groupingSets([["network"], ["network", "metric"]], "network", "metric").agg(F.avg("value").alias("mean"), F.grouping("metric").alias("overall"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("overall", "metric").orderBy(F.col("mean").desc(), "network"))).select("network", F.when(F.col("overall") == 0, F.col("metric")).alias("metric"), "mean", "rank")


def best_methods(df: DataFrame) -> DataFrame:
    """The method of the lowest mean value of each metric and config (first by name on ties)."""
    per = df.filter(SUCCESS).groupBy("config", "metric", "method").agg(F.avg("value").alias("mean")).filter("mean is not null")
    return per.withColumn("n", F.row_number().over(W.partitionBy("config", "metric").orderBy("mean", "method"))).filter("n = 1").drop("n")


def extremes(df: DataFrame, k: int = 5) -> DataFrame:
    """The k networks with the lowest and the highest mean value of all."""
    per = df.filter(SUCCESS).groupBy("network").agg(F.avg("value").alias("mean")).filter("mean is not null")
    return per.orderBy("mean", "network").limit(k).withColumn("kind", F.lit("easiest")).unionByName(per.orderBy(F.desc("mean"), "network").limit(k).withColumn("kind", F.lit("hardest")))


def degradation(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Mean, median and standard error per method and level of the config."""
    return df.filter(SUCCESS).join(levels, "config", "left").withColumn("level", F.coalesce("level", F.lit("Unknown"))).groupBy("method", "metric", "level").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))


def subset_study(df: DataFrame, networks: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean, median, std and count per metric on chosen networks and methods."""
    return df.filter(F.expr(SUCCESS) & F.col("method").isin(*methods)).join(networks, "network", "left_semi").groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def describe_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, min and max of each score column."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "metric", "value")
    return long.filter("value is not null").groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def conditions_table(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """A row per network with a column per condition, then rows MEAN and STD (sample) over the networks: ``network, condition, value``."""
    wide = df.groupBy(F.col("network").cast("string").alias("network")).pivot("condition", list(conditions)).agg(F.avg("value"))
    rows = [wide.agg(*(f(c).alias(c) for c in conditions)).select(F.lit(name).alias("network"), *conditions) for name, f in (("MEAN", F.avg), ("STD", F.stddev_samp))]
    return union_all([wide, *rows])


def retention_study(copies: DataFrame, removal: DataFrame) -> DataFrame:
    """Of polyploids, per network and for all: replicates, distinct species, mean copies, share left with one, and realised retention.

    ``copies`` is ``network, replicate, species, n, genes`` (in how many genes a species has n copies);
    ``removal`` is ``network, replicate, eligible, reduced``.
    """
    weight = F.col("genes")
    per = copies.rollup("network").agg(F.count_distinct("replicate").alias("replicates"), F.count_distinct("species").alias("polyploids"), (F.sum(F.col("n") * weight) / F.sum(weight)).alias("mean_copies"), (F.sum(F.when(F.col("n") == 1, weight).otherwise(0)) / F.sum(weight)).alias("single"))
    kept = removal.rollup("network").agg((1 - F.sum("reduced") / F.sum("eligible")).alias("retention"))
    return per.join(kept, per.network.eqNullSafe(kept.network), "left").select(per.network, "replicates", "polyploids", "mean_copies", "single", "retention")
