"""Aggregates as Column expressions, and the nearest-rank percentile as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import col, is_numeric, to_double, to_text


def compile_aggregate(a: dict, schema: T.StructType) -> Column:
    """All but ``percentile``; numbers are doubles, nulls are ignored."""
    fn = a["fn"]
    if fn == "count":
        return F.count(F.lit(1)).alias(a["alias"])
    name = a["column"]
    if name not in schema.names:
        raise KeyError(f"unknown column: {name}")
    c, kind = col(name), schema[name].dataType
    if fn == "count_distinct":
        out = F.count_distinct(to_text(c, kind) if isinstance(kind, T.MapType) else c)
    elif fn in ("min", "max"):
        # numbers as doubles; other types keep their own order
        c = c.cast("double") if is_numeric(kind) else c
        out = F.min(c) if fn == "min" else F.max(c)
    else:
        v = to_double(c, kind)
        out = {"sum": F.sum, "mean": F.avg, "std_dev": F.stddev_samp, "median": F.median}[fn](v)
    return out.alias(a["alias"])


def percentile(df: DataFrame, keys: list[str], a: dict) -> DataFrame:
    """(keys, alias): the value at index ``round(p / 100 * (n - 1))`` of each group's sorted non-null values.

    Values are counted before they are sorted, so repeats shrink on the map side and no
    group is collected into memory.  Without keys, a sketch first brackets the value, so
    that only a few distinct values are put in order by one task.
    """
    v = to_double(col(a["column"]), df.schema[a["column"]].dataType)
    by = [col(k) for k in keys]
    counts = df.select(*by, v.alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    if not keys:
        return bracketed(df.select(v.alias("__v")), counts, a)
    w = Window.partitionBy(*by).orderBy("__v")
    run = counts.select(*by, "__v", F.sum("__c").over(w).alias("__upto"), F.sum("__c").over(Window.partitionBy(*by)).alias("__n"))
    rank = F.floor(F.lit(a["p"] / 100.0) * (F.col("__n") - 1) + 0.5)
    return run.filter(F.col("__upto") > rank).groupBy(*by).agg(F.min("__v").alias(a["alias"]))


def bracketed(values: DataFrame, counts: DataFrame, a: dict) -> DataFrame:
    q, slack, accuracy = a["p"] / 100.0, 2e-4, 10_000
    ends = values.agg(F.count("__v").alias("__n"), F.percentile_approx("__v", [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias("__e"))
    ends = ends.select(F.floor(F.lit(q) * (F.col("__n") - 1) + 0.5).alias("__rank"), F.col("__e")[0].alias("__lo"), F.col("__e")[1].alias("__hi"))
    met = counts.crossJoin(F.broadcast(ends))  # one row
    below = met.filter("__v < __lo").agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("__below"))
    run = met.filter("__v >= __lo and __v <= __hi").withColumn("__upto", F.sum("__c").over(Window.orderBy("__v")))
    return run.crossJoin(F.broadcast(below)).filter(F.col("__below") + F.col("__upto") > F.col("__rank")).agg(F.min("__v").alias(a["alias"]))


def group(df: DataFrame, keys: list[str], aggs: list[dict]) -> DataFrame:
    """One row a group, null being a key of its own; no keys and no rows give no row."""
    for k in keys:
        if k not in df.columns:
            raise KeyError(f"unknown column: {k}")
    plain = [compile_aggregate(a, df.schema) for a in aggs if a["fn"] != "percentile"]
    # the count drops the row that SQL gives for no input
    out = df.groupBy(*[col(k) for k in keys]).agg(*plain, F.count(F.lit(1)).alias("__rows")).filter("__rows > 0").drop("__rows")
    for a in aggs:
        if a["fn"] == "percentile":
            side = percentile(df, keys, a)
            if not keys:
                out = out.join(side, F.lit(True), "left")
            else:
                names = [f"__k{i}" for i in range(len(keys))]
                side = side.select(*[col(k).alias(n) for k, n in zip(keys, names, strict=True)], col(a["alias"]))
                same = [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
                out = out.join(side, same, "left").drop(*names)
    return out.select(*[col(k) for k in keys], *[col(a["alias"]) for a in aggs])
