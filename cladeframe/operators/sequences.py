"""Statistics of alignments and of the trees and rates behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, value: str, by: str = "dataset") -> DataFrame:
    """n, min, max, mean, median, population std and quartiles per data set and for all (``Combined``)."""
    x = F.col(value)
    found = df.filter(x.isNotNull()).groupingSets([[by], []], by).agg(F.grouping(by).alias("all"), F.count("*").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_pop(x).alias("std"), F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.75).alias("q3"))
    return found.withColumn(by, F.when(F.col("all") == 1, "Combined").otherwise(F.col(by))).drop("all")


def substitution_rates(genes: DataFrame, species: DataFrame) -> DataFrame:
    """Rate per gene: its tree's height over the species tree's height in generations (million years x 1e6 / generation years)."""
    generations = F.col("height_my") * 1e6 / F.col("generation_years")
    return genes.join(F.broadcast(species), "dataset").filter(generations > 0).select("dataset", "gene", (F.col("height") / generations).alias("rate"))


def quality_check(alignments: DataFrame, least_length: int | None = None, least_sequences: int | None = None, most_gaps: float | None = None, least_informative: float | None = None, most_constant: float | None = None) -> DataFrame:
    """Each alignment with the reasons why it fails, by the limits that are given.

    The last two need ``informative_percentage`` and ``constant_percentage``, from the reports of a model fit
    (`readers.parse_model_report`); an alignment without a report passes them.
    """
    tests = []
    if least_length is not None:
        tests.append(F.when(F.col("length") < least_length, "short"))
    if least_sequences is not None:
        tests.append(F.when(F.col("sequences") < least_sequences, "few sequences"))
    if most_gaps is not None:
        tests.append(F.when(F.col("gaps") > most_gaps, "gaps"))
    if least_informative is not None:
        tests.append(F.when(F.col("informative_percentage") < least_informative, "few informative sites"))
    if most_constant is not None:
        tests.append(F.when(F.col("constant_percentage") > most_constant, "constant"))
    reasons = F.filter(F.array(*tests), lambda r: r.isNotNull()) if tests else F.array().cast("array<string>")
    return alignments.withColumn("reasons", reasons)


def pass_rate(checked: DataFrame) -> DataFrame:
    return checked.groupBy("dataset").agg(F.count("*").alias("n"), F.count(F.when(F.size("reasons") == 0, 1)).alias("passed"), F.avg((F.size("reasons") == 0).cast("double")).alias("rate"))


def outliers(values: DataFrame, column: str, most: float) -> DataFrame:
    """Per data set: values over ``most``, their share, and the means of both sides."""
    x = F.col(column)
    return values.filter(x.isNotNull()).groupBy("dataset").agg(F.count("*").alias("n"), F.count(F.when(x > most, 1)).alias("outliers"), F.avg((x > most).cast("double")).alias("share"), F.avg(F.when(x > most, x)).alias("mean_over"), F.avg(F.when(x <= most, x)).alias("mean_rest"))
