"""Shared-folder helpers: where small intermediate tables are written.

What an application settles lies in one folder of its own, ``tidemark-<application id>``, which ``forget`` removes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's part of the shared folder that nothing has been written to."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Remove everything this application has settled; results that still read it can no longer be computed."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write a small derived table (a profile, a change list) to the shared folder and read it back.

    Later joins then read this table instead of scanning the big input again.
    """
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
