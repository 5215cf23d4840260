"""Type labels and physical classes of columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The label printed for each Spark type.
TYPE_LABELS = {
    "byte": "TINYINT",
    "short": "SMALLINT",
    "integer": "INTEGER",
    "long": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "decimal": "DECIMAL",
    "string": "VARCHAR",
    "varchar": "VARCHAR",
    "char": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}

# Labels of each physical class.
INTEGER_LABELS = ["BIGINT", "INTEGER", "TINYINT", "SMALLINT", "HUGEINT"]
DOUBLE_LABELS = ["DOUBLE", "FLOAT", "DECIMAL"]
STRING_LABELS = ["VARCHAR", "STRING"]


def type_label(dt: T.DataType) -> str:
    """Label of a Spark type; types without a label keep Spark's own name."""
    return TYPE_LABELS.get(dt.typeName().split("(")[0], dt.simpleString().upper())


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_countable(dt: T.DataType) -> bool:
    """True if distinct values of the type can be counted by Spark."""
    if isinstance(dt, (T.MapType, T.VariantType)):
        return False
    if isinstance(dt, T.ArrayType):
        return is_countable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(is_countable(f.dataType) for f in dt.fields)
    return True


def physical_type(label: Column) -> Column:
    """Physical class of a type label; nested types are UNKNOWN."""
    label = F.upper(label)
    nested = label.rlike(r"[\[<(]") & ~label.startswith("DECIMAL(")
    return (
        F.when(nested, "UNKNOWN")
        .when(label.isin(INTEGER_LABELS), "INTEGER")
        .when(label.isin(DOUBLE_LABELS) | label.startswith("DECIMAL("), "DOUBLE")
        .when(label.isin(STRING_LABELS), "STRING")
        .when(label == "BOOLEAN", "BOOLEAN")
        .when(label.contains("DATE") | label.contains("TIME"), "DATETIME")
        .otherwise("UNKNOWN")
    )
