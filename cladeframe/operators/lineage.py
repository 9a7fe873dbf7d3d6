"""Cutting the lineage of plans that grow in a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, a local session uses a temporary folder; a cluster is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


#: Folders written by this process and not yet removed, by application.
_written: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the shared one; `remove_tables` removes it."""
    path = f"{shared_dir(spark)}/cladeframe-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_tables(spark: SparkSession) -> int:
    """Removes what operators have written to the shared folder in this session, and says how many folders.

    The caller does so once results made from them have been written: until then they are read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(path), True)
    return len(paths)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
