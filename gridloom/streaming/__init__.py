"""Views over unbounded sources: the operations that need no order and no end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates
from ..operators import pipeline
from ..plans.view import canonical

STATELESS = ("filter", "select", "drop", "derive", "rename")


def apply_stream(df: DataFrame, ops: list[dict], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The view's rows as a stream; a group-by keeps running state, bounded by a watermark on ``time`` if its column is a key."""
    f = pipeline.Frame(df, tuple(df.columns))
    for op in canonical(ops):
        if op["type"] == "group_by":
            if any(a["fn"] in ("percentile", "median", "count_distinct") for a in op["aggs"]):
                raise ValueError("percentile, median and count_distinct have no bounded state")
            base = f.shown.withWatermark(time, late) if time else f.shown
            out = base.groupBy(*op["keys"]).agg(*[aggregates.compile_aggregate(a, base.schema) for a in op["aggs"]])
            f = pipeline.Frame(out, tuple(out.columns))
        elif op["type"] in STATELESS:
            step = {"filter": pipeline.op_filter, "select": pipeline.op_select, "drop": pipeline.op_drop, "derive": pipeline.op_derive}
            if op["type"] == "rename":
                to = dict(op["mappings"])
                out = f.df.select(*[F.col(f"`{n}`").alias(to.get(n, n)) for n in f.names])
                f = pipeline.Frame(out, tuple(out.columns))
            else:
                f = step[op["type"]](f, op)
        else:
            raise ValueError(f"{op['type']} needs the whole input")
    return f.shown
