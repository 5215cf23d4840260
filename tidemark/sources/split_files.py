"""Reading one huge CSV or JSON-array file by many tasks.

Neither format can be cut at any byte: a newline may lie inside quotes, and a brace inside a text or a deeper
object. So a file is read as text in its natural blocks, ended by newlines (CSV) or closing braces (JSON), and what
a block begins inside of is found afterwards:

* CSV: a newline ends a record if an even number of quotes lies before it. Each block gives the parity of its quotes; a prefix sum
  over the blocks of a file (a small table) gives the parity each begins with.
* JSON: whether a brace is inside a text follows from the quotes in the same way, and its depth from the braces and
  brackets outside of texts. A block sums up as (parity of quotes, depth gained if it begins outside of a text, depth gained if
  inside); these compose from block to block.

Records on one line, or elements without inner objects, are then whole rows. Only pieces of longer ones are grouped, by file
and number of the record, so a group is as long as one record. Each text is shuffled once, by block, which no key can
make uneven.

Quotes are to be used as the writer here and RFC 4180 use them: around a whole field, doubled inside. Elements of JSON
arrays are objects. A record that does not fit the schema stops the read, or is set aside by ``split_malformed_*``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .readers import CORRUPT, NO_VALUE

CSV_OPTIONS = {"escape": '"', "nullValue": NO_VALUE}
_BLOCK = ["file", "block"]


def _here():
    """The pieces of a block in the order of the file."""
    return W.partitionBy(*_BLOCK).orderBy("pos")


def _before():
    return _here().rowsBetween(W.unboundedPreceding, -1)


def _so_far():
    return _here().rowsBetween(W.unboundedPreceding, 0)


def _earlier():
    """The blocks of a file before one."""
    return W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block, pos, text: what lies between separators, with its place. Each block is read by one task."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"),
    )


def _sum_before(c: Column | str, window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def _quotes(c: str) -> Column:
    return F.length(c) - F.length(F.replace(F.col(c), F.lit('"'), F.lit("")))


def _inferred(texts: DataFrame, fmt: str, options: dict) -> T.StructType:
    """The schema Spark's own reader infers from a column of texts; only JVM callers are given that reader."""
    spark = texts.sparkSession
    column = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    found = getattr(spark.read.options(**options)._jreader, fmt)(column).schema()
    return T.StructType.fromJson(json.loads(found.json()))


# CSV


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (its text, newlines inside quotes kept), is_head, whole (false for one whose quotes never end)."""
    lines = _pieces(spark, path, "\n").drop("size").withColumn("odd", _quotes("text") % 2)
    # Where the first line of a file ends in a carriage return, those in front of newlines are part of the line ends.
    returns = F.min_by(F.col("text").endswith("\r"), F.col("pos"))
    blocks = lines.groupBy(*_BLOCK).agg(F.sum("odd").alias("odds"), returns.alias("returns"))
    blocks = blocks.select(*_BLOCK, _sum_before("odds", _earlier()).alias("odds_before"), F.bool_or((F.col("block") == 0) & F.col("returns")).over(W.partitionBy("file")).alias("returns"))
    placed = (
        lines.join(blocks, _BLOCK)
        .withColumn("n", F.col("odds_before") + _sum_before("odd", _before()))  # lines of odd quotes before this one
        .withColumn("is_head", (F.col("block") == 0) & (F.row_number().over(_here()) == 1))
    )
    alone = "n % 2 = 0 AND odd = 0"
    placed = placed.withColumn("text", F.when(F.col("returns"), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))).drop("returns")
    single = placed.where(alone).select("file", F.col("text").alias("record"), "is_head", F.lit(True).alias("whole"))
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "text")))
    long = placed.where(f"NOT ({alone})").groupBy("file", F.expr("n div 2").alias("record")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.bool_or("is_head").alias("is_head"), (F.sum("odd") == 2).alias("whole")
    )
    both = single.unionByName(long.select("file", F.col("text").alias("record"), "is_head", "whole"))
    return both.where("is_head OR trim(record) <> ''")


def _csv_names(records: DataFrame) -> list[str]:
    """Column names of the first record of the first file."""
    head = records.where("is_head").agg(F.min_by("record", "file")).first()[0]
    if head is None:
        raise ValueError("a CSV version needs a line of column names")
    spark = records.sparkSession
    one = spark.range(1).select(F.lit(head).alias("value"))
    return [f.name for f in _inferred(one, "csv", {"escape": '"', "header": True}).fields]


def csv_schema(records: DataFrame) -> T.StructType:
    """Names from the head, types as Spark infers them, in one pass over all records by all tasks."""
    names = _csv_names(records)
    rows = records.where("NOT is_head").select(F.col("record").alias("value"))
    found = _inferred(rows, "csv", {**CSV_OPTIONS, "inferSchema": True}).fields
    types = [f.dataType for f in found[: len(names)]] + [T.StringType()] * (len(names) - len(found))
    return T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])


def _csv_rows(spark: SparkSession, path: str, schema: T.StructType | None, options: dict) -> tuple[DataFrame, T.StructType]:
    records = csv_records(spark, path)
    schema = schema or csv_schema(records)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if options["mode"] == "PERMISSIVE" else schema
    read = F.from_csv("record", _ddl(wide), {**CSV_OPTIONS, **options})
    return records.where("NOT is_head").select("record", "whole", read.alias("row")), schema


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows ``read_version`` gives, with every file read by as many tasks as it has blocks."""
    rows, schema = _csv_rows(spark, path, schema, {"mode": "FAILFAST"})
    ended = F.when(F.col("whole"), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("Malformed dataset file. Quotes without end: "), F.left("record", F.lit(200)))).cast(rows.schema["row"].dataType))
    return rows.select(ended.alias("row")).select("row.*")


def split_malformed_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows with their raw text)."""
    rows, schema = _csv_rows(spark, path, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    names = [f"`{f.name}`" for f in schema.fields]
    raw = F.col(f"row.`{CORRUPT}`")
    bad = raw.isNotNull() | ~F.col("whole")
    good = rows.where(~bad).select("row.*").select(*names)
    return good, rows.where(bad).select("row.*", "record").withColumn(CORRUPT, F.col("record")).drop("record")


# JSON arrays


def _gained(c: Column) -> Column:
    """Depth gained by a text that begins outside of quotes, where an open quote runs to its end."""
    bare = F.regexp_replace(c, '"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, element: the objects at the top level of each file's array (or of the file, where it has none)."""
    pieces = _pieces(spark, path, "}").withColumn("plain", F.regexp_replace("text", r"\\.", ""))
    rest = F.regexp_replace("plain", '^[^"]*("|$)', "")  # what follows the quoted text that a piece may begin in
    odd = F.col("odd")
    # A brace ends each piece; it counts where the piece ends outside of quotes.
    pieces = pieces.withColumn("odd", _quotes("plain") % 2)
    pieces = pieces.select(
        *_BLOCK, "pos", "text", "size", "odd", (F.col("block") == 0).alias("at_start"),
        (_gained(F.col("plain")) - F.when(odd == 0, 1).otherwise(0)).alias("outside"), (_gained(rest) - F.when(odd == 1, 1).otherwise(0)).alias("inside"),
    )
    even = _sum_before("odd", _before()) % 2 == 0
    placed = (
        pieces.withColumn("odd_here", F.when(even, 0).otherwise(1))
        .withColumn("gain_0", F.when(even, F.col("outside")).otherwise(F.col("inside")))
        .withColumn("gain_1", F.when(even, F.col("inside")).otherwise(F.col("outside")))
        .withColumn("at", F.row_number().over(_here()))
    )
    opens = F.max(F.when((F.col("at") == 1) & F.col("at_start") & F.col("text").rlike(r"^\s*\["), 1).otherwise(0))
    blocks = placed.groupBy(*_BLOCK).agg(
        F.sum("odd").alias("odds"), F.sum("gain_0").alias("g0"), F.sum("gain_1").alias("g1"), opens.alias("opens"),
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"), F.max("size").alias("size"),
    )
    blocks = blocks.withColumn("begins", _sum_before("odds", _earlier()) % 2)
    whole_file = W.partitionBy("file")
    block_gain = F.when(F.col("begins") == 0, F.col("g0")).otherwise(F.col("g1"))
    blocks = blocks.withColumn("depth", _sum_before(block_gain, _earlier())).withColumn("total", F.sum(block_gain).over(whole_file))
    # Where the pieces with a brace each are longer than the file, the last one had none.
    blocks = blocks.withColumn("braceless", (F.sum("bytes").over(whole_file) > F.max("size").over(whole_file)))
    blocks = blocks.withColumn("top", F.max("opens").over(whole_file)).withColumn("total", F.col("total") + F.col("braceless").cast("int"))
    blocks = blocks.withColumn("ends_at", F.when(F.col("braceless") & (F.col("block") == F.max("block").over(whole_file)), F.col("n")))
    cut = blocks.where("total = 1 AND top = 1").select("file").distinct()  # arrays without an end
    blocks = blocks.select(*_BLOCK, "begins", "depth", "top", "ends_at")
    gain = F.when(F.col("begins") == 0, F.col("gain_0")).otherwise(F.col("gain_1"))
    known = (
        placed.join(blocks, _BLOCK)
        .withColumn("gain", gain)
        .withColumn("after", F.col("depth") + F.sum("gain").over(_so_far()))
        .withColumn("closes", ((F.col("begins") + F.col("odd_here") + odd) % 2 == 0) & (F.col("after") == F.col("top")) & ~F.col("at").eqNullSafe(F.col("ends_at")))
        .withColumn("was", F.col("after") - F.col("gain"))
    )
    alone = "closes AND was <= top"
    single = known.where(alone).select("file", F.concat("text", F.lit("}")).alias("element"))
    open_ = known.withColumn("opens_here", F.expr(f"CAST(was <= top AND NOT ({alone}) AS INT)"))
    count = open_.groupBy(*_BLOCK).agg(F.sum("opens_here").alias("opened"))
    count = count.select(*_BLOCK, _sum_before("opened", _earlier()).alias("opened_before"))
    numbered = open_.join(count, _BLOCK).withColumn("number", F.col("opened_before") + F.sum("opens_here").over(_so_far()))
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "text")))
    long = numbered.where(f"NOT ({alone})").groupBy("file", "number").agg(F.transform(parts, lambda p: p["text"]).alias("parts"), F.bool_or("closes").alias("closed"))
    joined = long.select("file", F.concat(F.array_join("parts", "}"), F.when(F.col("closed"), "}").otherwise("")).alias("element"), "closed")
    # What is behind the last element is no element; anything but the end of the array there is malformed.
    tail = joined.where(~F.col("closed") & ~F.col("element").rlike(r"^\s*\[?\s*\]?\s*$"))
    found = single.unionByName(joined.where("closed").drop("closed")).unionByName(tail.drop("closed")).unionByName(cut.withColumn("element", F.concat(F.lit("{ array without end in "), "file")))
    return found.select("file", F.regexp_replace("element", r"^[\s,\[]+", "").alias("element"))


def json_schema(elements: DataFrame) -> T.StructType:
    """The schema Spark infers, in one pass over all elements by all tasks."""
    found = _inferred(elements.select(F.col("element").alias("value")), "json", {})
    return T.StructType([f for f in found.fields if f.name != CORRUPT])


def _json_rows(spark: SparkSession, path: str, schema: T.StructType | None, options: dict) -> tuple[DataFrame, T.StructType]:
    elements = json_elements(spark, path)
    schema = schema or json_schema(elements)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if options["mode"] == "PERMISSIVE" else schema
    return elements.select("element", F.from_json("element", wide, options).alias("row")), schema


def read_json_split(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows ``read_version`` gives for files of JSON arrays, with every file read by as many tasks as it has blocks."""
    return _json_rows(spark, path, schema, {"mode": "FAILFAST"})[0].select("row.*")


def split_malformed_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed elements with their raw text)."""
    rows, schema = _json_rows(spark, path, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    raw = F.col(f"row.`{CORRUPT}`")
    good = rows.where(raw.isNull()).select("row.*").select(*[f"`{f.name}`" for f in schema.fields])
    return good, rows.where(raw.isNotNull()).select("row.*")
