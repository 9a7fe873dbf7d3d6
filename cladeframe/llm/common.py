"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a cluster is refused, since a
    machine-local folder would lose what other executors must read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders written by this process and not yet removed, by application.
_written: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the shared one; `remove_tables` removes it."""
    path = f"{shared_dir(spark)}/cladeframe-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_tables(spark: SparkSession) -> int:
    """Removes what operators have written to the shared folder in this session; returns how many folders.

    To be called when results made from them have been written: until then they are read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(path), True)
    return len(paths)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: str | Column) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Lowers the session's Arrow batches to ``rows`` rows at most: texts may be long, and a Python worker holds a batch at once.

    Plans are lazy, so the setting stays for what follows in the session; a lower one is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(key, rows)
    return df


def spread_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, parts: int = 64) -> DataFrame:
    """The rows of ``big`` joined with ``small``, whose column ``rows`` says how many rows of ``big`` each of its (distinct) keys has.

    Keys with over a thousandth of these rows are fewer than a thousand, so they can be broadcast;
    their rows are dealt over ``parts`` tasks, the others by key alone. ``small`` is read three times
    and ``big`` must be read in a fixed order, so both are best written tables or made from them by
    maps. Columns of ``small`` but ``rows`` are added.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    frequent = F.col(rows) > total / 1000
    heavy = small.filter(frequent).select(*on, F.lit(True).alias("__heavy"))
    dealt = big.join(F.broadcast(heavy), on, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0)).drop("__heavy")
    every = small.withColumn("__salt", F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop(rows)
    return dealt.join(every, [*on, "__salt"]).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
