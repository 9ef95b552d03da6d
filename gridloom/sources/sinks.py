"""Sinks: a view's rows as Parquet, CSV, JSON lines or Arrow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import col, to_text

# Content types of the formats.
CONTENT_TYPES = {"parquet": "application/vnd.apache.parquet", "csv": "text/csv", "arrow": "application/vnd.apache.arrow.stream", "jsonl": "application/x-ndjson"}
GROUP_BYTES = 512 << 20


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat = [to_text(col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType, T.TimestampType, T.TimestampNTZType)) else col(f.name) for f in df.schema]
    df.select(*flat).write.mode(mode).csv(path, header=True)


def json_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON object a row, nulls written, numbers that aren't finite as null, other types as text."""
    out: list[Column] = []
    for f in df.schema:
        c, kind = col(f.name), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif not isinstance(kind, (T.IntegralType, T.BooleanType, T.StringType)):
            c = to_text(c, kind)
        out.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)


def arrow_stream(df: DataFrame) -> bytes:
    """An Arrow IPC stream; for results that fit the driver."""
    t = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def rewrite(df: DataFrame, path: str, sort: list[str] | None = None, bloom: list[str] | None = None) -> None:
    """The source again with row groups of 512 MiB, Snappy and statistics, at a new path.

    Sorting narrows the row groups' value ranges; ``bloom`` columns get Parquet's own
    bloom filters, so that equality filters skip row groups.
    """
    out = (df.sortWithinPartitions(*sort) if sort else df).write.option("parquet.block.size", GROUP_BYTES).option("compression", "snappy")
    for c in bloom or ():
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    if fmt not in CONTENT_TYPES:
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "arrow":
        with open(path, "wb") as f:
            f.write(arrow_stream(df))
    else:
        {"parquet": write_parquet, "csv": write_csv, "jsonl": write_jsonl}[fmt](df, path, mode)
