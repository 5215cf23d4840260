"""Reading and writing dataset versions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Format of each file extension.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".ndjson": "ndjson", ".json": "json"}
DEFAULT_MAX_BYTES = 1 << 30
CORRUPT = "_corrupt_record"
NO_VALUE = "\x00"


def format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"Unsupported format: {ext}")
    return FORMATS[ext]


def _reader(spark: SparkSession, fmt: str, multiline: bool = True):
    if fmt == "parquet":
        return spark.read.format("parquet")
    if fmt == "csv":
        # An empty field is null and a quoted empty one is the empty text, as no field holds the mark given for null.
        reader = spark.read.format("csv").option("header", True).option("escape", '"').option("nullValue", NO_VALUE)
        return reader.option("multiLine", multiline)
    if fmt in ("json", "ndjson"):
        return spark.read.format("json").option("multiLine", fmt == "json")
    raise ValueError(f"Unsupported format: {fmt}")


def infer_schema(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = True) -> T.StructType:
    """Column names and types of a version, without a corrupt-record column."""
    fmt = fmt or format_of(path)
    reader = _reader(spark, fmt, multiline)
    if fmt == "csv":
        reader = reader.option("inferSchema", True)
    fields = [f for f in reader.load(path).schema.fields if f.name != CORRUPT]
    return T.StructType(fields)


def read_version(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    max_bytes: int | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Read one version of a dataset; the format follows the extension unless given.

    A row that does not fit the schema fails the job. Give ``schema`` to skip the inference pass. CSV fields may hold
    newlines inside quotes, so each file is read by one task; ``multiline=False`` splits large files that have none.
    """
    fmt = fmt or format_of(path)
    if max_bytes is not None:
        require_size(spark, path, max_bytes)
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    schema = schema or infer_schema(spark, path, fmt, multiline)
    # Without column pruning every field of a CSV row is checked, whatever the query selects.
    return (
        _reader(spark, fmt, multiline).schema(schema).option("mode", "FAILFAST").option("columnPruning", False).load(path)
    )


def split_malformed(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows with their raw text) of a CSV or JSON version."""
    fmt = fmt or format_of(path)
    schema = schema or infer_schema(spark, path, fmt)
    if fmt == "parquet":
        good = spark.read.schema(schema).parquet(path)
        return good, good.limit(0).withColumn(CORRUPT, F.lit(None).cast("string"))
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        _reader(spark, fmt)
        .schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .load(path)
    )
    # Spark refuses a scan of the raw text alone, as in a count, so the tests name the last column as well.
    # A malformed row never equals its own last field.
    raw, last = F.col(CORRUPT), F.col(f"`{schema.fields[-1].name}`").cast("string")
    good = rows.filter(raw.isNull() | (raw == last)).drop(CORRUPT)
    return good, rows.filter(raw.isNotNull() & ~raw.eqNullSafe(last))


def require_wellformed(spark: SparkSession, path: str, fmt: str | None = None) -> None:
    """Raise ValueError if the version cannot be read or holds a malformed row."""
    fmt = fmt or format_of(path)
    try:
        bad = split_malformed(spark, path, fmt)[1].take(1)
    except Exception as e:
        raise ValueError(f"Malformed dataset file. Parser error: {e}") from e
    if bad:
        raise ValueError(f"Malformed dataset file. Parser error: {bad[0][CORRUPT]}")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files of a version; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def oversize_files(spark: SparkSession, path: str, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    return list_files(spark, path).filter(F.col("length") > max_bytes)


def require_size(spark: SparkSession, path: str, max_bytes: int = DEFAULT_MAX_BYTES) -> None:
    """Raise ValueError if the files of a version together exceed ``max_bytes``."""
    size = list_files(spark, path).agg(F.sum("length")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"Dataset exceeds maximum size: {size} > {max_bytes} bytes")


def write_version(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write a new version; an existing path is an error, so no version changes in place.

    CSV keeps blanks and newlines, and writes a null as an empty field and an empty text as a quoted one. With a single
    column an empty line would be no row at all, so there a null is refused.
    """
    fmt = fmt or format_of(path)
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        if len(df.columns) == 1 and not df.filter(F.col(f"`{df.columns[0]}`").isNull()).isEmpty():
            raise ValueError("a CSV version of one column cannot hold nulls")
        kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**kept).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt == "ndjson":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")
    return path
