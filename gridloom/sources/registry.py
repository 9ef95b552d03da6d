"""The engine: registered sources, their views, and a small cache of persisted views."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import label
from ..operators import pipeline
from ..operators import profile as profiles
from ..operators import tiles as windows
from ..operators.pipeline import PLACE, Frame
from ..plans import export
from ..plans.view import View, canonical
from . import footers, sinks
from .detect import detect_format, detect_kind, infer_name
from .readers import SourceError, open_source, placed

CACHED_VIEWS = 32


@dataclass
class Source:
    id: str
    name: str
    uri: str
    kind: str
    format: str
    files: list[str]
    df: DataFrame
    stamp: tuple = ()
    sorted_by: list[dict] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[dict]:
        fields = [f for f in self.df.schema if f.name != PLACE]
        return [{"index": i, "name": f.name, "data_type": label(f.dataType), "nullable": f.nullable} for i, f in enumerate(fields)]


def _stamp(files: list[str]) -> tuple:
    return tuple((f, os.stat(f).st_size, os.stat(f).st_mtime_ns) for f in files if os.path.isfile(f))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {}
        self._kept: OrderedDict[tuple, DataFrame] = OrderedDict()

    # --- sources ---

    def register(self, uri: str, name: str | None = None) -> Source:
        df, files = open_source(self.spark, uri)
        kind = detect_kind(uri)
        out = Source(uuid.uuid4().hex, name or infer_name(uri), uri, kind, detect_format(uri, kind), files, df, _stamp(files))
        if out.format in ("parquet", "delta", "iceberg") and all(os.path.isfile(f) for f in files):
            out.sorted_by, out.recommendations = footers.sorted_by(files), footers.recommendations(files)
        self.sources[out.id] = out
        return out

    def upload(self, data, name: str) -> Source:
        """An Arrow table or a pandas DataFrame as a source."""
        out = Source(uuid.uuid4().hex, name, f"upload://{name}", "upload", "arrow", [], self.spark.createDataFrame(placed(data)))
        self.sources[out.id] = out
        return out

    def registered(self) -> list[Source]:
        return [*self.sources.values()]

    def get(self, source_id: str) -> Source:
        if source_id not in self.sources:
            raise SourceError(f"unknown source: {source_id}")
        source = self.sources[source_id]
        if _stamp(source.files) != source.stamp and source.stamp:
            raise SourceError(f"source_modified: {source.uri}")
        return source

    def remove(self, source_id: str) -> None:
        self.sources.pop(source_id, None)
        for k in [k for k in self._kept if k[0] == source_id]:
            self._kept.pop(k).unpersist()

    def browse(self) -> list[dict]:
        """Tables of the session's catalogue."""
        return [{"name": t.name, "database": t.database, "type": t.tableType} for t in self.spark.catalog.listTables()]

    def quick_stats(self, source_id: str) -> dict[str, dict]:
        return footers.quick_stats(self.get(source_id).files)

    # --- views ---

    def frame(self, view: View) -> Frame:
        source = self.get(view.source_id)
        ops = canonical(view.ops)
        if [op["type"] for op in ops] == ["sort"] and ops[0]["keys"] and source.sorted_by[: len(ops[0]["keys"])] == ops[0]["keys"]:
            ops = []  # the file has that order already
        return pipeline.run(pipeline.with_place(source.df), ops, normalise=False)

    def query(self, view: View) -> DataFrame:
        f = self.frame(view)
        return f.df.orderBy(*f.order).select(*[F.col(f"`{n}`") for n in f.names]) if f.sorted else f.shown

    def persist(self, view: View) -> Frame:
        """The view's rows kept by the executors; the least recently used of over 32 views is dropped."""
        key = (view.source_id, self.get(view.source_id).stamp, view.key())
        f = self.frame(view)
        if key not in self._kept:
            self._kept[key] = f.df.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.move_to_end(key)
        while len(self._kept) > CACHED_VIEWS:
            self._kept.popitem(last=False)[1].unpersist()
        return Frame(self._kept[key], f.names, f.order, f.sorted)

    def tile(self, view: View, row: int = 0, column: int = 0, rows: int = windows.TILE_ROWS, columns: int = windows.TILE_COLS) -> DataFrame:
        source = self.get(view.source_id)
        if not view.ops and source.format == "parquet":
            return windows.source_tile(source.df, row, column, rows, columns)
        return windows.tile(self.frame(view), row, column, rows, columns)

    def tiles(self, view: View, wanted: list[tuple[int, int, int, int]]) -> list[DataFrame]:
        """Several tiles of one view, which is computed once."""
        f = self.persist(view)
        return [windows.tile(f, *w) for w in wanted]

    def count(self, view: View) -> int:
        """Rows of the view; those of an unchanged local Parquet source come from the files' footers."""
        source = self.get(view.source_id)
        if not view.ops and source.format == "parquet" and source.files and all(os.path.isfile(f) for f in source.files):
            return footers.row_count(source.files)
        return self.frame(view).shown.count()

    def schema(self, view: View) -> list[dict]:
        return windows.view_schema(self.frame(view))

    def download(self, view: View, path: str, fmt: str) -> None:
        sinks.write(self.query(view), path, fmt)

    def code(self, view: View, target: str) -> str:
        source = self.get(view.source_id)
        return export.code(view.ops, source.uri, [c["name"] for c in source.columns], target)

    # --- profiles ---

    def search(self, source_id: str, text: str, columns: list[str] | None = None, limit: int = 100) -> list[int]:
        return [r.row_id for r in windows.search(self.get(source_id).df, text, columns, limit).collect()]

    def profile(self, source_id: str) -> DataFrame:
        return profiles.column_stats(self.get(source_id).df)

    def column_stats(self, source_id: str, column: str, bins: int = profiles.BINS, emit: Callable | None = None) -> dict:
        """One column's statistics, histogram and top values; ``emit`` gets the quick look first."""
        df = self.get(source_id).df
        if emit is not None:
            emit(profiles.column_stats_coarse(df, [column]).first().asDict())
        out = profiles.column_stats(df, [column]).first().asDict()
        numeric = out["mean"] is not None or out["p50"] is not None
        out["histogram"] = [r.asDict() for r in profiles.histogram(df, column, bins).orderBy("bucket").collect()] if numeric else []
        out["top_values"] = [r.asDict() for r in profiles.top_values(df, column).collect()]
        return out

    def correlations(self, source_id: str) -> DataFrame:
        return profiles.correlations(self.get(source_id).df)

    def row_group_stats(self, source_id: str, column: str) -> list[dict]:
        return footers.row_group_stats(self.get(source_id).files, column)

    def landmarks(self, source_id: str, most: int | None = profiles.LANDMARKS) -> DataFrame:
        """What a viewer shows; None for all."""
        return profiles.landmarks(self.get(source_id).df, most=most)

    def inspect(self, uri: str) -> dict:
        """Rows and columns of a source, which isn't kept."""
        source = self.register(uri)
        try:
            return {"rows": self.count(View(source.id)), "columns": source.columns}
        finally:
            self.remove(source.id)
