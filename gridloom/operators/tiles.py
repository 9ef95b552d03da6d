"""Windows of a view's rows and columns, their summaries, counts, and text search."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import col, is_numeric, label, to_text
from . import pipeline
from .pipeline import PLACE, Frame

TILE_ROWS, TILE_COLS = 256, 64


def tile(frame: Frame, row: int = 0, column: int = 0, rows: int = TILE_ROWS, columns: int = TILE_COLS) -> DataFrame:
    """Rows ``row ..`` and columns ``column ..`` of a view; a bounded top-k, not a full sort."""
    names = frame.names[column : column + columns]
    return frame.df.orderBy(*frame.order).offset(row).limit(rows).select(*[col(n) for n in names])


def source_tile(df: DataFrame, row: int = 0, column: int = 0, rows: int = TILE_ROWS, columns: int = TILE_COLS) -> DataFrame:
    """A tile of an unchanged source whose place is the row number: a range filter, no sort of the source."""
    names = [c for c in df.columns if c != PLACE][column : column + columns]
    return df.filter((F.col(PLACE) >= row) & (F.col(PLACE) < row + rows)).orderBy(PLACE).select(*[col(n) for n in names])


def legacy_tile(df: DataFrame, where: dict | None = None, sort: dict | None = None, row: int = 0, column: int = 0, rows: int = TILE_ROWS, columns: int = TILE_COLS) -> DataFrame:
    """A tile of a source by one condition and one sort column (nulls last): filtered, then sorted, then cut."""
    ops = [{"type": "filter", "predicate": where}] if where is not None else []
    ops += [{"type": "sort", "keys": [sort | {"nulls_last": True}]}] if sort is not None else []
    return tile(pipeline.run(df, ops), row, column, rows, columns)


def tile_bytes(df: DataFrame) -> bytes:
    """A tile as an Arrow IPC stream."""
    t = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def tile_summary(df: DataFrame) -> DataFrame:
    """One row: per column its mean (0 if it isn't numeric), share of nulls, and type (0 number, 1 text or other, 2 boolean, 3 null)."""
    out = []
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    for f in df.schema:
        c = col(f.name)
        out.append((F.coalesce(F.avg(c.cast("double")), F.lit(0.0)) if is_numeric(f.dataType) else F.lit(0.0)).alias(f"{f.name}_mean"))
        out.append((F.count(F.when(c.isNull(), 1)) / n).alias(f"{f.name}_null_pct"))
        kind = 0 if is_numeric(f.dataType) else 2 if isinstance(f.dataType, T.BooleanType) else 3 if isinstance(f.dataType, T.NullType) else 1
        out.append(F.lit(kind).alias(f"{f.name}_type_char"))
    return df.agg(*out)


def view_schema(frame: Frame) -> list[dict]:
    return [{"index": i, "name": n, "data_type": label(frame.df.schema[n].dataType), "nullable": frame.df.schema[n].nullable} for i, n in enumerate(frame.names)]


def search(df: DataFrame, text: str, columns: list[str] | None = None, limit: int = 100) -> DataFrame:
    """(row_id) of the first rows of which some column's text contains ``text``, case-sensitively."""
    f = pipeline.with_place(df)
    names = [c for c in (f.names if columns is None else columns) if c in f.names]
    if not names:
        return f.df.filter(F.lit(False)).select(F.col(PLACE).alias("row_id"))
    found = reduce(lambda a, b: a | b, [F.coalesce(to_text(col(c), f.df.schema[c].dataType).contains(text), F.lit(False)) for c in names])
    return f.df.filter(found).select(F.col(PLACE).alias("row_id")).orderBy("row_id").limit(limit)


# --- tile arithmetic ------------------------------------------------------

# Fixed values: (least zoom, tile size).
ROWS_AT_ZOOM = ((1.0, 256), (0.5, 512), (0.25, 1024), (0.1, 2048), (-math.inf, 4096))
COLS_AT_ZOOM = ((1.0, 64), (0.5, 128), (-math.inf, 256))


def tile_rows_at(zoom: float) -> int:
    return next(n for least, n in ROWS_AT_ZOOM if zoom >= least)


def tile_cols_at(zoom: float) -> int:
    return next(n for least, n in COLS_AT_ZOOM if zoom >= least)


def tile_rows_for_group(rows: int) -> int:
    """Tile height for a row group: whole small groups, a sixteenth of middling ones, at most 8192."""
    return rows if rows <= 1024 else rows // 16 if rows <= 131_072 else 8192


def tile_range(row_tile: int, col_tile: int, n_rows: int, n_cols: int, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS) -> tuple[int, int, int, int]:
    """First row, first column, rows and columns of a tile, cut at the table's edges."""
    row, column = row_tile * tile_rows, col_tile * tile_cols
    return row, column, max(0, min(row + tile_rows, n_rows) - row), max(0, min(column + tile_cols, n_cols) - column)


def visible_tiles(x: float, y: float, width: float, height: float, cell_width: float, cell_height: float, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS, ahead: int = 0) -> list[tuple[int, int]]:
    """(row tile, column tile) that a viewport touches, and ``ahead`` more on each side, rows first."""
    w, h = cell_width * tile_cols, cell_height * tile_rows
    rows = range(max(0, int(y / h) - ahead), math.ceil((y + height) / h) + ahead)
    cols = range(max(0, int(x / w) - ahead), math.ceil((x + width) / w) + ahead)
    return [(r, c) for r in rows for c in cols]


def tile_key(source_id: str, view_key: str, row_tile: int, col_tile: int) -> str:
    return f"tt:tile:{source_id}:{view_key}:{row_tile}:{col_tile}"
