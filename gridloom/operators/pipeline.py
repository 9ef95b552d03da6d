"""The view pipeline: each operation takes a lazy DataFrame to a lazy DataFrame.

Rows have a place in the source (``Frame.place``), hidden columns that order them;
after a group-by it is the sorted keys.  Catalyst does pushdown, pruning and the
choice of physical operators: sort and limit become a bounded top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates
from ..functions.predicates import compile_predicate
from ..functions.scalars import compile_scalar, order_by
from ..functions.types import col
from ..plans.view import canonical
from . import ordinal

PLACE = "__place"
SEED = 0x517CC1B727220A95


@dataclass(frozen=True)
class Frame:
    """Rows, the names that show, and the order they have: sort keys, then place."""

    df: DataFrame
    names: tuple[str, ...]
    order: tuple[Column, ...] = ()
    sorted: bool = False

    @property
    def shown(self) -> DataFrame:
        return self.df.select(*[col(n) for n in self.names])


def with_place(df: DataFrame, place: Column | None = None) -> Frame:
    """``place`` orders the rows; by default their order in the scan."""
    names = tuple(n for n in df.columns if n != PLACE)
    if PLACE not in df.columns:
        df = df.withColumn(PLACE, F.monotonically_increasing_id() if place is None else place)
    return Frame(df, names, (F.col(PLACE),))


def op_filter(f: Frame, op: dict) -> Frame:
    return replace(f, df=f.df.filter(compile_predicate(op["predicate"], f.df.schema)))


def op_select(f: Frame, op: dict) -> Frame:
    return replace(f, names=tuple(dict.fromkeys(c for c in op["columns"] if c in f.names)))


def op_drop(f: Frame, op: dict) -> Frame:
    return replace(f, names=tuple(c for c in f.names if c not in op["columns"]))


def op_derive(f: Frame, op: dict) -> Frame:
    """A column of that name is replaced in its place.

    A rank or tile number of all rows is counted by partitions, which runs jobs.
    """
    kind, df = op["expr"]["kind"], f.df
    if kind == "rank" or kind == "n_tile" and op["expr"]["n"] > 0:
        keys = order_by(op["expr"]["order"], df.columns) if kind == "rank" else []
        df, rows = ordinal.numbered(df, [*keys, *f.order])
        at = F.col(ordinal.NUMBER)
        value = at if kind == "rank" else F.floor((at - 1) * F.lit(op["expr"]["n"]) / F.lit(max(rows, 1))).cast("bigint") + F.lit(1).cast("bigint")
    else:
        value = compile_scalar(op["expr"], df.schema, lambda: list(f.order), op.get("typed", False))
    return replace(f, df=df.withColumn(op["name"], value).drop(ordinal.NUMBER), names=f.names if op["name"] in f.names else (*f.names, op["name"]))


def op_deduplicate(f: Frame, op: dict) -> Frame:
    """All columns: distinct rows.  Some: each key's first row in the order of rows."""
    keys = [c for c in (f.names if op.get("columns") is None else op["columns"]) if c in f.names]
    if not keys:
        return f
    if op.get("columns") is None or set(keys) == set(f.names):
        # the least place of equal rows keeps their order; partial aggregation first
        out = f.df.groupBy(*[col(n) for n in f.names]).agg(F.min(F.col(PLACE)).alias(PLACE)) if PLACE in f.df.columns else f.shown.distinct()
        return replace(f, df=out)
    first = Window.partitionBy(*[col(k) for k in keys]).orderBy(*f.order)
    return replace(f, df=f.df.withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first"))


def op_sample(f: Frame, n: int, seed: int | None) -> Frame:
    """Exactly ``min(n, rows)`` rows, the least by a seeded hash of their place; the same ones each time."""
    spread = F.xxhash64(F.col(PLACE), F.lit((SEED if seed is None else seed) % 2**63))
    return replace(f, df=f.df.withColumn("__h", spread).orderBy("__h", PLACE).limit(n).drop("__h"))


def op_group_by(f: Frame, op: dict) -> Frame:
    out = aggregates.group(f.df, op["keys"], op["aggs"])
    names = tuple(out.columns)
    keys = [col(k).asc_nulls_last() for k in op["keys"]]
    place = F.struct(*[x for k in op["keys"] for x in (col(k).isNull(), col(k))]) if op["keys"] else F.lit(0)
    return Frame(out.withColumn(PLACE, place), names, tuple(keys) or (F.col(PLACE),), True)


def op_rename(f: Frame, op: dict) -> Frame:
    """All at once, so that two names can be swapped."""
    to = {a: b for a, b in op["mappings"] if a in f.names}
    rest = [c for c in f.df.columns if c not in f.names and c not in to.values()]
    df = f.df.select(*[col(n).alias(to.get(n, n)) for n in f.names], *[col(c) for c in rest])
    return Frame(df, tuple(to.get(n, n) for n in f.names), (F.col(PLACE),), f.sorted)


def op_sort(f: Frame, op: dict) -> Frame:
    keys = order_by(op["keys"], list(f.names) + [c for c in f.df.columns if c != PLACE])
    return replace(f, order=(*keys, F.col(PLACE)), sorted=True) if keys else f


def op_limit(f: Frame, n: int) -> Frame:
    return replace(f, df=f.df.orderBy(*f.order).limit(n))


def run(df: DataFrame | Frame, ops: list[dict], normalise: bool = True) -> Frame:
    f = df if isinstance(df, Frame) else with_place(df)
    pending = None  # approximate: an exact-size sample of what the aggregation reads
    for op in canonical(ops) if normalise else ops:
        kind = op["type"]
        if kind == "approximate":
            pending = op
            continue
        if kind == "group_by" and pending is not None:
            f, pending = op_sample(f, pending["sample_rows"], pending.get("seed", 42)), None
        if kind == "sample":
            f = op_sample(f, op["n"], op.get("seed"))
        elif kind == "limit":
            f = op_limit(f, op["n"])
        elif kind == "top_k":
            f = op_limit(op_sort(f, op), op["n"])
        else:
            f = {"filter": op_filter, "select": op_select, "drop": op_drop, "derive": op_derive, "deduplicate": op_deduplicate, "group_by": op_group_by, "rename": op_rename, "sort": op_sort}[kind](f, op)
    return f


def apply(df: DataFrame | Frame, ops: list[dict], ordered: bool = True) -> DataFrame:
    """The view's rows; sorted if an operation sorts and ``ordered``."""
    f = run(df, ops)
    return (f.df.orderBy(*f.order).select(*[col(n) for n in f.names])) if ordered and f.sorted else f.shown
