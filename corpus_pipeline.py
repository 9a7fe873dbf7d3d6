"""From raw documents to packed training sequences: language ID, exact and near dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import decontamination, language_id
from cladeframe.llm.common import cut, table
from cladeframe.llm.components import joined_away
from cladeframe.llm.exact_dedup import exact_dedup
from cladeframe.llm.jaccard_dedup import jaccard_dedup
from cladeframe.llm.packing import default_tokenizer, pack_documents
from cladeframe.llm.simhash_dedup import simhash_dedup

#: Sorts after every doc_id, for rows that have none.
LAST = 2**63 - 1


def _one_of_each(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], chosen: str) -> DataFrame:
    """The rows of which ``decide`` says that they are the one of their group; of rows that repeat id and text, one.

    Documents are told apart by id and a 128-bit hash of the text, so rows with a repeated or no id
    are decided each. The decisions are joined back to the rows, which is the one time that texts move.
    """
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__hash": F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))}).withColumn("__key", F.struct("__id", "__hash"))
    kept = decide(keyed).filter(F.col("doc_id") == F.col(chosen)).select("doc_id.__id", "doc_id.__hash").distinct()
    return keyed.drop("__key").join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; texts that the calibrated models reject go."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return _one_of_each(docs, lambda d: exact_dedup(d, id_col="__key"), "keep_id")


def _near_classes(docs: DataFrame) -> DataFrame:
    """Of each class of near copies the smallest key, named by itself.

    Classes by SimHash and by sets are one where they share a document.
    """
    away = joined_away(simhash_dedup(docs, id_col="__key"), jaccard_dedup(docs, id_col="__key"))
    return docs.select(F.col("__key").alias("doc_id")).join(away, "doc_id", "left_anti").withColumn("component_id", F.col("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id.

    Documents are linked whose SimHashes differ in 3 or fewer bits (`simhash_dedup`, ball hashing), and
    those with 0.8 or more of shingles of five words in common: their SimHashes differ in some ten of
    64 bits, and a ball of that size cannot be spelled out.
    """
    return _one_of_each(docs, _near_classes, "component_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most 2048 tokens."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No stage but the second can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a written table, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
