"""Type names of the view language and their Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTS = {
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "text": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
}

LABELS = {
    T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64",
    T.StringType: "Utf8", T.BooleanType: "Boolean", T.DateType: "Date32", T.TimestampType: "Timestamp", T.TimestampNTZType: "Timestamp",
    T.BinaryType: "Binary", T.ArrayType: "List", T.StructType: "Struct", T.MapType: "Map", T.NullType: "Null",
}


def label(kind: T.DataType) -> str:
    return LABELS.get(type(kind), kind.simpleString())


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def to_text(c: Column, kind: T.DataType | None) -> Column:
    """Text of a value; timestamps as ISO 8601 with ``T``, binary as UTF-8, nested values as JSON."""
    if kind is not None and is_time(kind):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0*$", ""))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def to_double(c: Column, kind: T.DataType | None) -> Column:
    """A value as double; null where it isn't a number."""
    if kind is not None and is_numeric(kind):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return c.try_cast("double")
    if kind is None:
        return c.try_cast("double")
    return F.lit(None).cast("double")
