"""Scalar expressions as Column expressions.

Arithmetic is in doubles, and division or remainder by zero is NaN; casts that fail are
null; text positions start at 0; ``length`` counts UTF-8 bytes; ``coalesce`` and ``case``
give text unless ``typed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import compile_predicate, predicate_columns
from .types import CASTS, col, to_double, to_text

ONE = ("abs", "floor", "ceil", "upper", "lower", "trim", "length", "year", "month", "day")


def argument(e: dict) -> dict:
    return e["expr"] if "expr" in e else e["0"]


def kind_of(e: dict, schema: T.StructType) -> T.DataType | None:
    """The expression's type as far as text rendering needs it."""
    k = e["kind"]
    if k == "column":
        return schema[e["name"]].dataType
    if k == "literal":
        v = e["value"]
        return T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
    if k in ("bin_op", "abs", "round", "floor", "ceil"):
        return T.DoubleType()
    if k in ("length", "year", "month", "day"):
        return T.IntegerType()
    if k in ("rank", "n_tile"):
        return T.LongType()
    if k == "cast":
        return T.StructType.fromDDL(f"x {CASTS[e['to_type']]}")[0].dataType
    return T.StringType()


def order_by(keys: list[dict], names: list[str]) -> list[Column]:
    """Sort keys; unknown columns are ignored."""
    out = []
    for k in keys:
        if k["column"] in names:
            c, last = col(k["column"]), k.get("nulls_last", True)
            out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if k.get("descending") else c.asc_nulls_last() if last else c.asc_nulls_first())
    return out


def compile_scalar(e: dict, schema: T.StructType, row_id: Callable[[], list[Column]] | None = None, typed: bool = False) -> Column:
    """``row_id`` gives the columns that order rows by their place in the source."""

    def go(x: dict) -> Column:
        return compile_scalar(x, schema, row_id, typed)

    def number(x: dict) -> Column:
        return to_double(go(x), kind_of(x, schema))

    def text(x: dict) -> Column:
        return to_text(go(x), kind_of(x, schema))

    k = e["kind"]
    nan = F.lit(float("nan"))
    if k == "column":
        if e["name"] not in schema.names:
            raise KeyError(f"unknown column: {e['name']}")
        return col(e["name"])
    if k == "literal":
        return F.lit(e["value"])
    if k == "bin_op":
        a, b = number(e["left"]), number(e["right"])
        op = e["op"]
        if op in ("div", "mod"):
            return F.when(a.isNotNull() & (b == 0), nan).otherwise(a / F.when(b != 0, b) if op == "div" else a % F.when(b != 0, b))
        return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[op]()
    if k == "abs":
        return F.abs(number(argument(e)))
    if k == "round":
        v, scale = number(argument(e)), 10.0 ** e.get("decimals", 0)
        scaled = v * F.lit(scale)
        # half away from zero, in doubles
        up = F.floor(F.abs(scaled)).cast("double")
        whole = F.when(F.abs(scaled) - up >= 0.5, up + 1).otherwise(up)
        return F.when(F.isnan(v) | (F.abs(scaled) >= 2.0**52), v).otherwise(F.signum(scaled) * whole / F.lit(scale))
    if k in ("floor", "ceil"):
        v = number(argument(e))
        return F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise((F.floor(v) if k == "floor" else F.ceil(v)).cast("double"))
    if k == "upper":
        return F.upper(text(argument(e)))
    if k == "lower":
        return F.lower(text(argument(e)))
    if k == "trim":
        return F.regexp_replace(text(argument(e)), r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")
    if k == "length":
        return F.octet_length(text(argument(e))).cast("int")
    if k == "substr":
        c, start, n = text(e["expr"]), e["start"], e.get("len")
        if start < 0 or (n is not None and n < 0):
            return F.when(c.isNotNull(), F.lit(""))
        return F.substring(c, start + 1, 2**31 - 2 - start if n is None else n)
    if k == "concat":
        return F.concat(*[text(x) for x in e["parts"]]) if e["parts"] else F.lit("")
    if k == "cast":
        inner, kind = go(argument(e)), kind_of(argument(e), schema)
        return to_text(inner, kind) if e["to_type"] == "text" else inner.try_cast(CASTS[e["to_type"]])
    if k in ("year", "month", "day"):
        c, kind = go(argument(e)), kind_of(argument(e), schema)
        c = c if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else c.try_cast("date")
        return {"year": F.year, "month": F.month, "day": F.dayofmonth}[k](c)
    if k == "coalesce":
        parts = [go(x) if typed else text(x) for x in e["exprs"]]
        return F.coalesce(*parts) if parts else F.lit(None).cast("string")
    if k == "case":
        value = go if typed else text
        out = None
        for p, x in e["whens"]:
            out = F.when(compile_predicate(p, schema), value(x)) if out is None else out.when(compile_predicate(p, schema), value(x))
        other = value(e["else_expr"]) if e.get("else_expr") is not None else F.lit(None)
        return out.otherwise(other) if out is not None else other.cast("string")
    if k in ("rank", "n_tile"):
        place = row_id() if row_id else [F.monotonically_increasing_id()]
        keys = order_by(e["order"], schema.names) if k == "rank" else []
        number_ = F.row_number().over(Window.orderBy(*keys, *place)).cast("bigint")
        if k == "rank":
            return number_
        n = e["n"]
        if n == 0:
            return F.lit(1).cast("bigint")
        total = F.count(F.lit(1)).over(Window.partitionBy())
        return F.expr("1L") + F.floor((number_ - 1) * F.lit(n) / total).cast("bigint")
    raise ValueError(f"unknown expression: {k}")


def scalar_columns(e: dict) -> set[str]:
    k = e["kind"]
    if k == "column":
        return {e["name"]}
    if k == "literal" or k == "n_tile":
        return set()
    if k == "rank":
        return {x["column"] for x in e["order"]}
    if k == "bin_op":
        return scalar_columns(e["left"]) | scalar_columns(e["right"])
    if k == "concat":
        return set().union(*map(scalar_columns, e["parts"]))
    if k == "coalesce":
        return set().union(*map(scalar_columns, e["exprs"]))
    if k == "case":
        out = set() if e.get("else_expr") is None else scalar_columns(e["else_expr"])
        return out.union(*[predicate_columns(p) | scalar_columns(x) for p, x in e["whens"]])
    return scalar_columns(argument(e))
