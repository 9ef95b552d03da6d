"""Readers: a URI to a lazy DataFrame with the rows' place in the source.

Parquet rows carry ``_metadata.row_index`` plus the rows of the files before, which one
count by file gives, wherever the files are; a filter or a projection still reaches the scan.
Text files are numbered by the counts of their blocks.
"""

from __future__ import annotations

import glob
import json
import os
import posixpath

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pipeline import PLACE
from .detect import detect_format, detect_kind

#: Up to so many files, rows are numbered across files by a map of file starts.
MAX_NUMBERED = 1000


class SourceError(ValueError):
    pass


def local_path(uri: str) -> str:
    return uri.removeprefix("file://")


def expand(uri: str) -> list[str]:
    """The local Parquet files of a glob, a folder or a file, in order."""
    path = local_path(uri)
    if any(c in path for c in "*?["):
        found = sorted(p for p in glob.glob(path) if p.endswith(".parquet"))
        if not found:
            raise SourceError(f"no Parquet files match {uri}")
        return found
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/*.parquet") if os.path.isfile(p)) or [path]
    return [path]


def cloud_path(uri: str) -> str:
    """The URI as Hadoop's connectors name it."""
    for short, name in (("s3://", "s3a://"), ("gcs://", "gs://"), ("az://", "abfs://")):
        if uri.startswith(short):
            return name + uri[len(short) :]
    return uri


def same_schemas(files: list[str]) -> None:
    """Files of one source have the same fields; footers only."""
    first = None
    for f in files:
        fields = [(x.name, str(x.type)) for x in pq.read_schema(f)]
        first = first or fields
        if fields != first:
            raise SourceError(f"schema mismatch: {files[0]} and {f}")


def read_parquet(spark: SparkSession, files: list[str], place: bool = True) -> DataFrame:
    if len(files) > 1 and all(os.path.isfile(local_path(f)) for f in files):
        same_schemas(files)
    df = spark.read.parquet(*files)
    if not place:
        return df
    if len(files) == 1 and os.path.isfile(local_path(files[0])):
        return df.withColumn(PLACE, F.col("_metadata.row_index"))
    if len(set(files)) < len(files):  # a file given twice: its rows can't be told apart by where they are
        return df.withColumn(PLACE, F.monotonically_increasing_id())
    return after_starts(df, F.col("_metadata.file_path"), F.lit(0).cast("bigint"), F.col("_metadata.row_index"))


def after_starts(df: DataFrame, path: Column, block: Column, index: Column) -> DataFrame:
    """The rows with their place: ``index`` counts from its least value in a (path, block); these follow in order.

    One job counts by (path, block), one row each; footers do for Parquet.
    """
    parts = df.select(path.alias("path"), block.alias("block"), index.alias("i")).groupBy("path", "block").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    if len(few := parts.limit(MAX_NUMBERED + 1).collect()) <= MAX_NUMBERED:
        starts, at = [], 0
        for r in sorted(few, key=lambda r: (r.path, r.block)):
            starts += [F.lit(f"{r.block} {r.path}"), F.lit(at - r.low).cast("bigint")]
            at += r.n
        if len(few) < 2:
            return df.withColumn(PLACE, (index + starts[1] if few else index).cast("bigint"))
        return df.withColumn(PLACE, (F.create_map(*starts)[F.concat_ws(" ", block.cast("string"), path)] + index).cast("bigint"))
    before = F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("path").alias("__path"), F.col("block").alias("__block"), (F.coalesce(before, F.lit(0)) - F.col("low")).alias("__start"))
    met = df.withColumns({"__path": path, "__block": block, "__i": index}).join(starts, ["__path", "__block"], "left")
    return met.withColumn(PLACE, F.col("__start") + F.col("__i")).drop("__path", "__block", "__start", "__i")


def numbered(df: DataFrame) -> DataFrame:
    """Rows of text files with their place; a block's rows have consecutive ids."""
    return after_starts(df, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def placed(data) -> pa.Table:
    """An Arrow table or a pandas DataFrame as an Arrow table with rows' places."""
    t = data if isinstance(data, pa.Table) else pa.Table.from_pandas(data, preserve_index=False)
    return t.append_column(PLACE, pa.array(range(len(t)), pa.int64()))


def read_csv(spark: SparkSession, uri: str) -> DataFrame:
    tab = uri.lower().split("?")[0].endswith(".tsv")
    return spark.read.csv(cloud_path(uri), header=True, inferSchema=True, sep="\t" if tab else ",", enforceSchema=False)


def read_json(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.json(cloud_path(uri))


def read_arrow(spark: SparkSession, uri: str) -> DataFrame:
    """An Arrow IPC file with its rows' places; it is read by the driver, as Spark can't split its format, so it must fit there."""
    import pyarrow.ipc

    with pyarrow.ipc.open_file(local_path(uri)) as f:
        return spark.createDataFrame(placed(f.read_all()))


def delta_files(uri: str) -> list[str]:
    """Active files of a local Delta table, by replay of its JSON log in order."""
    top = uri.removeprefix("delta://").removeprefix("file://").rstrip("/")
    log = f"{top}/_delta_log"
    if not os.path.isdir(log):
        raise SourceError(f"_delta_log not found at {top}")
    live: dict[str, None] = {}
    for name in sorted(x for x in os.listdir(log) if x.endswith(".json")):
        with open(f"{log}/{name}", encoding="utf-8") as f:
            for line in filter(str.strip, f):
                action = json.loads(line)
                if "remove" in action:
                    live.pop(action["remove"]["path"], None)
                if "add" in action:
                    live[action["add"]["path"]] = None
    return sorted(f"{top}/{x}" for x in live)


def iceberg_files(uri: str) -> list[str]:
    """Parquet files of an Iceberg table's current snapshot: metadata, manifest list and manifests as local JSON."""
    path = uri.removeprefix("iceberg://")
    if not (path.startswith("/") or path.endswith(".json")):
        raise SourceError("an Iceberg REST catalogue needs a network; give a metadata file")
    with open(path, encoding="utf-8") as f:
        meta = json.load(f)
    shots = meta.get("snapshots") or []
    shot = next((s for s in shots if s["snapshot-id"] == meta.get("current-snapshot-id")), shots[-1] if shots else None)
    if shot is None or not shot.get("manifest-list"):
        raise SourceError("no snapshot with a manifest list")
    base = posixpath.dirname(path)

    def load(p: str):
        p = local_path(p)
        with open(p if p.startswith("/") else f"{base}/{p}", "rb") as g:
            raw = g.read()
        if raw[:4] == b"Obj\x01":
            raise SourceError("Avro manifests need Spark's Avro package")
        return json.loads(raw)

    out = []
    for m in load(shot["manifest-list"]):
        for e in load(m["manifest_path"]):
            if e.get("status") != 2:  # 2: deleted
                p = (e.get("data_file") or e)["file_path"]
                out.append(local_path(p) if local_path(p).startswith("/") else f"{base}/{p}")
    return sorted(out)


def read_database(spark: SparkSession, uri: str, table: str, **options: str) -> DataFrame:
    """A database table over JDBC; give ``partitionColumn``, bounds and ``numPartitions`` to read in parallel."""
    scheme, rest = uri.split("://", 1)
    url = f"jdbc:{ {'postgres': 'postgresql'}.get(scheme, scheme)}://{rest}"
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_clickhouse(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=f"jdbc:clickhouse://{url}", dbtable=table, driver="com.clickhouse.jdbc.ClickHouseDriver", **options).load()


def open_source(spark: SparkSession, uri: str, place: bool = True) -> tuple[DataFrame, list[str]]:
    """The source's rows, with their place, and its files."""
    kind = detect_kind(uri)
    fmt = detect_format(uri, kind)
    if kind == "hugging_face":
        raise SourceError("dataset hubs need a network; download the Parquet files")
    if fmt == "database":
        raise SourceError("use read_database with a table name")
    if fmt in ("delta", "iceberg"):
        files = delta_files(uri) if fmt == "delta" else iceberg_files(uri)
        return read_parquet(spark, files, place), files
    if fmt == "parquet":
        files = expand(uri) if kind == "local_file" else [cloud_path(uri)]
        return read_parquet(spark, files, place), files
    df = {"csv": read_csv, "json": read_json, "arrow": read_arrow}[fmt](spark, uri)
    return (df if place and fmt == "arrow" else numbered(df) if place else df.drop(PLACE)), [local_path(uri)]
