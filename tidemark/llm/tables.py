"""Reading the given tables, shipping this package to the workers, and names that never clash with a caller's."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker is sent at once. Spark's 10,000 are 30 MB or more of texts, held several times over by the task
#: and its worker, and as much again for their k-mers; pairs with the k-mers of both are larger still.
BATCH_ROWS = 1_000
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, wherever the driver was started, and send them texts in
    batches of ``BATCH_ROWS`` unless the session has a batch size of its own."""
    if spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def once(function):
    """A Python function that Spark evaluates once a row, also where its result is filtered.

    Otherwise Spark moves the filter below the projection with a copy of the function, so a task sends each text twice, to
    two workers at once, and the executor keeps both. What is named nondeterministic isn't copied; results are the same.
    """
    return function.asNondeterministic()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until the table has no such column (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
