"""Greedy choices in an order, made in rounds by windows instead of one by one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def greedy(rows: DataFrame, item: Sequence[str], pool: Sequence[str], order: Sequence[Column], room: Column, scope: Sequence[str] = ()) -> DataFrame:
    """The rows of the items that are taken when items are met in order and each takes a place in all of its pools, or none where one is full.

    ``rows`` has a row per item and pool that it needs; ``room`` is a pool's number of places. An item's turn comes after
    those before it that share a pool: it is taken once the taken and the undecided ones before it leave
    room in each of its pools, and goes once the taken ones alone leave none in one. A round decides at least the
    first item that is left in every set of linked pools, and in practice nearly all, for few items wait for many others in
    turn. Each round is one written table. With ``scope``, columns of both item and pool with many values,
    rows are dealt by these alone, one shuffle a round, and what is decided in a scope leaves the rounds.
    """
    columns = rows.columns
    before = W.partitionBy(*pool).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*item)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)).over(before), F.lit(0))
    dealt = lambda d: d.repartition(*scope) if scope else d
    rows, done = cut(rows.withColumns({"__room": room, "__taken": F.lit(False), "__open": F.lit(True)}), "items"), []
    while not rows.filter("not __taken").isEmpty():
        counted = dealt(rows).withColumns({"__have": n(F.col("__taken")), "__wait": n(~F.col("__taken"))})
        fits = F.min(F.col("__have") + F.col("__wait") < F.col("__room")).over(whole)
        full = F.max(F.col("__have") >= F.col("__room")).over(whole)
        decided = counted.withColumns({"__fits": fits, "__full": full}).filter("__taken or not __full")
        rows = decided.withColumn("__taken", F.col("__taken") | F.col("__fits"))
        if scope:
            rows = rows.withColumn("__open", F.max(~F.col("__taken")).over(W.partitionBy(*scope)))
        rows = cut(rows.select(*columns, "__room", "__taken", "__open"), "items")
        if scope:
            done, rows = [*done, rows.filter("not __open")], rows.filter("__open")
    return reduce(DataFrame.unionByName, done, rows).select(columns)
