"""A Spark session with the settings the jobs are meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Shuffle partitions that a cluster starts from; adaptive execution merges those that turn out small.
INITIAL_PARTITIONS = 20_000


def session(master: str | None = None, cores: int | None = None, initial_partitions: int = INITIAL_PARTITIONS, **conf: str) -> SparkSession:
    """Build a session. On a cluster leave ``master`` out and let the submit settings decide.

    ``initial_partitions`` holds on a cluster only: with 100 TB to shuffle, 20,000 partitions are 5 GB each before merging.

    Adaptive execution sizes the shuffles and splits skewed joins; the initial partition number is set high
    on a cluster and coalesced at run time.
    """
    builder = SparkSession.builder.appName("tidemark")
    if master or cores:
        builder = builder.master(master or f"local[{cores}]")
        builder = builder.config("spark.sql.shuffle.partitions", str(cores or 8))
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Without this every column expression built in Python also sends its call site to the JVM.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if not (master or cores):
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions)
    settings |= conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
