"""Schema, file and content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import table_hash
from ..functions.types import type_label
from .readers import list_files

#: Files up to this size are hashed as one value.
WHOLE_BYTES = 1 << 30


def schema_rows(df: DataFrame, dataset_id: str) -> DataFrame:
    """One row per column: (dataset_id, ordinal, column, type), plus the row count of the table."""
    fields = [
        F.struct(
            F.lit(i).cast("int").alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(type_label(f.dataType)).alias("type"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    rows = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("f", F.explode(F.array(*fields)))
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "f.*", "row_count")


def schema_fingerprint(schema: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """First 16 hex digits of the sha256 of the sorted ``name:type`` texts of each schema."""
    pairs = F.sort_array(F.collect_list(F.concat_ws(":", "column", "type")))
    digest = F.sha2(F.array_join(pairs, ""), 256)
    return schema.groupBy(*keys).agg(F.left(digest, F.lit(16)).alias("schema_fingerprint"))


def file_fingerprints(spark: SparkSession, path: str, schema_fp: str = "") -> DataFrame:
    """Fingerprint of each file from its path, size, modification time and schema fingerprint."""
    modified = F.unix_micros("modified").cast("string")
    text = F.concat_ws("_", "path", F.col("length").cast("string"), modified, F.lit(schema_fp))
    return list_files(spark, path).withColumn("fingerprint", F.left(F.sha2(text, 256), F.lit(16)))


def file_hashes(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, sha256) of each file, of any size.

    A file of up to ``whole_bytes`` is one value of Spark's file reader, which ends at 2 GB; a longer one is read in
    pieces of 8 MB by the task that holds its path, so no task holds more. The digests are the same either way.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_bytes).select("path", "length")

    def digests(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.fs

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                store, name = pyarrow.fs.FileSystem.from_uri(row["path"])
                digest = hashlib.sha256()
                with store.open_input_stream(name) as file:
                    while piece := file.read(1 << 23):
                        digest.update(piece)
                out.append({**row, "sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())]))

    # A number of partitions, as adaptive execution would else put these few rows into one task.
    dealt = large.repartition(max(1, min(large.count(), 1000)), "path")
    return small.unionByName(dealt.mapInArrow(digests, "path string, length bigint, sha256 string"))


def content_hash(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row count and order-free hash of a table, or of each group of it."""
    values = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), table_hash(df, values).alias("content_hash")
    )


def content_digest(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row count and order-free digest of a table, or of each group of it, that other engines can recompute.

    The sum of the first 60 bits of the SHA-256 of each row: of every value as text the number of bytes, a colon and the
    text, ``-`` for a null. Slower than ``content_hash``, and free of Spark's own hash function.
    """
    values = [F.col(f"`{c}`").cast("string") for c in df.columns if c not in by]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    row = F.conv(F.left(F.sha2(F.concat(*parts), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").alias("content_digest"))


def table_fingerprint(df: DataFrame) -> str:
    """Content hash of a table as 16 hex digits, for lineage rows."""
    row = content_hash(df).select(
        F.left(F.sha2(F.concat_ws("_", F.col("row_count").cast("string"), F.col("content_hash").cast("string")), 256), F.lit(16))
    )
    return row.first()[0]
