"""Inventories of runs: what exists, what is complete, what failed and how long it took."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("network", "config", "method", "replicate")
ERRORS = ("ERROR", "FAILED", "EXCEPTION", "TRACEBACK")


def full_inventory(networks: DataFrame, found: DataFrame) -> DataFrame:
    """Every network with every config, method and replicate that is met at all, and whether a result was found.

    The grid is as large as the study's design, not as its results; the results are reduced to
    distinct keys before the join.
    """
    have = found.select(*KEYS).distinct()
    grid = networks.select("network").distinct()
    for k in KEYS[1:]:
        grid = grid.crossJoin(F.broadcast(found.select(k).distinct()))
    return grid.join(have.withColumn("met", F.lit(True)), list(KEYS), "left").select(*KEYS, F.coalesce("met", F.lit(False)).alias("inferred_exists"))


def completion_report(inventory: DataFrame) -> DataFrame:
    """Expected, available, missing and rate: overall, per method and per network (null where it is for all)."""
    ok = F.col("inferred_exists").cast("long")
    return inventory.groupingSets([[], ["method"], ["network"]], "method", "network").agg(F.count("*").alias("expected"), F.sum(ok).alias("available"), F.sum(1 - ok).alias("missing"), (F.avg(ok) * 100).alias("rate"))


def unit_status(found: DataFrame, expected: int) -> DataFrame:
    """SUCCESS with all expected parts, PARTIAL with a good one, else MISSING."""
    good = F.sum(F.col("good").cast("long"))
    return found.groupBy("unit").agg(F.count("*").alias("found"), F.when(F.count("*") >= expected, "SUCCESS").when(good > 0, "PARTIAL").otherwise("MISSING").alias("status"))


def first_errors(lines: DataFrame, k: int = 5, width: int = 200) -> DataFrame:
    """The first k lines of each task that name an error, cut to ``width`` characters."""
    hit = lines.filter(F.col("line").rlike(f"(?i){'|'.join(ERRORS)}"))
    return hit.withColumn("k", F.row_number().over(W.partitionBy("task").orderBy("at"))).filter(F.col("k") <= k).withColumn("line", F.substring("line", 1, width))


def flagged_runs(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Lines of each run that contain a warning pattern, by pattern."""
    marks = F.array(*(F.when(F.contains("line", F.lit(p)), F.lit(p)) for p in patterns))
    return lines.select("run", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("pattern")).groupBy("run", "pattern").agg(F.count("*").alias("hits"))


def latest_jobs(durations: DataFrame) -> DataFrame:
    """The last job of each task and method."""
    return durations.groupBy("task", "method").agg(F.max_by("seconds", "job").alias("seconds"))


def runtime_summary(durations: DataFrame) -> DataFrame:
    s = F.col("seconds")
    return latest_jobs(durations).groupBy("method").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))


def changed_pairs(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pairs of texts whose hashes are not both as in the manifest: ``key, truth_hash, inferred_hash``."""
    hashed = pairs.select("key", F.sha2("truth", 256).alias("truth_hash"), F.sha2("inferred", 256).alias("inferred_hash"))
    return hashed.join(manifest, ["key", "truth_hash", "inferred_hash"], "left_anti")
