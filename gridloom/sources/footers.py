"""What Parquet footers tell without a scan."""

from __future__ import annotations

import pyarrow.parquet as pq

SMALL_GROUP = 64 << 20


def _columns(meta) -> list[str]:
    return [meta.schema.column(i).path for i in range(meta.num_columns)]


def quick_stats(files: list[str]) -> dict[str, dict]:
    """Per column: nulls, and least and largest value of numbers, over all files' row groups."""
    out: dict[str, dict] = {}
    for f in files:
        meta = pq.read_metadata(f)
        for name_at, name in enumerate(_columns(meta)):
            held = out.setdefault(name, {"null_count": 0, "min": None, "max": None})
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(name_at).statistics
                if s is None:
                    continue
                held["null_count"] += s.null_count or 0
                if s.has_min_max and s.physical_type in ("INT32", "INT64", "FLOAT", "DOUBLE") and isinstance(s.min, (int, float)):
                    held["min"] = s.min if held["min"] is None else min(held["min"], s.min)
                    held["max"] = s.max if held["max"] is None else max(held["max"], s.max)
    return out


def row_group_stats(files: list[str], column: str) -> list[dict]:
    """Per row group: place, rows, nulls, least, largest, and their middle."""
    out, at = [], 0
    for f in files:
        meta = pq.read_metadata(f)
        names = _columns(meta)
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            s = group.column(names.index(column)).statistics
            low, high = (s.min, s.max) if s is not None and s.has_min_max and isinstance(s.min, (int, float)) else (None, None)
            out.append({"rg_index": len(out), "row_offset": at, "row_count": group.num_rows, "null_count": (s.null_count or 0) if s is not None else 0, "min": low, "max": high, "mean": None if low is None else (low + high) / 2})
            at += group.num_rows
    return out


def sorted_by(files: list[str]) -> list[dict]:
    """The sort keys that all row groups of all files declare; none if they differ or there are several files."""
    found = None
    if len(files) != 1:
        return []
    meta = pq.read_metadata(files[0])
    names = _columns(meta)
    for g in range(meta.num_row_groups):
        keys = [(names[k.column_index], k.descending, not k.nulls_first) for k in meta.row_group(g).sorting_columns or ()]
        if found is not None and keys != found:
            return []
        found = keys
    return [{"column": c, "descending": d, "nulls_last": n} for c, d, n in found or ()]


def recommendations(files: list[str]) -> list[str]:
    """``small_row_groups`` (under 64 MiB on average), ``missing_statistics``, ``no_bloom_filters``."""
    groups = size = 0
    bare = bloomless = False
    for f in files:
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            groups, size = groups + 1, size + group.total_byte_size
            for c in range(group.num_columns):
                column = group.column(c)
                bare |= not column.is_stats_set
                bloomless |= getattr(column, "bloom_filter_offset", None) is None
    out = ["small_row_groups"] if groups > 1 and size / groups < SMALL_GROUP else []
    return out + ["missing_statistics"] * bare + ["no_bloom_filters"] * bool(bloomless and groups)


def row_count(files: list[str]) -> int:
    return sum(pq.read_metadata(f).num_rows for f in files)
