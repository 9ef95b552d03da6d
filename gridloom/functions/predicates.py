"""Predicates as Column expressions.

A literal decides how a column is compared: a number numerically (text columns by
``try_cast``), a text with the column's text, a bool with the column as boolean, null
never matches.  AND, OR and NOT follow three-valued logic; string matches are false
on null, so their negation keeps null rows.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import col, is_numeric, is_time, to_double, to_text

COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_DAY = re.compile(r"\d{4}-\d\d-\d\d")


def compare(name: str, op: str, value, schema: T.StructType) -> Column:
    c, kind = col(name), schema[name].dataType
    if value is None or isinstance(value, (dict, list)):
        return F.lit(False)
    if isinstance(value, bool):
        c = c if isinstance(kind, T.BooleanType) else c.try_cast("boolean") if isinstance(kind, (T.StringType, T.NumericType)) else F.lit(None).cast("boolean")
        return COMPARE[op](c, F.lit(value))
    if isinstance(value, (int, float)):
        # numbers are compared natively, so that the filter reaches the Parquet scan
        return COMPARE[op](c if is_numeric(kind) else to_double(c, kind), F.lit(value))
    if isinstance(kind, T.StringType):
        return COMPARE[op](c, F.lit(value))
    if is_time(kind) and _DAY.fullmatch(value):
        # a day sorts before all its times; as a timestamp the comparison is pushed down
        day = F.lit(value).cast(kind)
        return {"gt": c >= day, "gte": c >= day, "lt": c < day, "lte": c < day, "eq": F.when(c.isNotNull(), F.lit(False)), "ne": F.when(c.isNotNull(), F.lit(True))}[op]
    return COMPARE[op](to_text(c, kind), F.lit(value))


def compile_predicate(p: dict, schema: T.StructType) -> Column:
    op = p["op"]
    if op in ("and", "or"):
        parts = [compile_predicate(x, schema) for x in p["exprs"]]
        return reduce(operator.and_ if op == "and" else operator.or_, parts, F.lit(op == "and")) if parts else F.lit(op == "and")
    if op == "not":
        return ~compile_predicate(p["expr"], schema)
    name = p["column"]
    if name not in schema.names:
        raise KeyError(f"unknown column: {name}")
    if op in COMPARE:
        return compare(name, op, p["value"], schema)
    if op == "between":
        return compare(name, "gte", p["lo"], schema) & compare(name, "lte", p["hi"], schema)
    if op in ("in", "not_in"):
        values = [v for v in p["values"] if v is not None]
        kind = schema[name].dataType
        if not values:
            inside = F.lit(False)
        elif all(isinstance(v, str) for v in values) and isinstance(kind, T.StringType) or all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) and is_numeric(kind):
            inside = col(name).isin(values)
        else:
            inside = reduce(operator.or_, [compare(name, "eq", v, schema) for v in values])
        return inside if op == "in" else ~inside
    if op == "is_null":
        return col(name).isNull()
    if op == "is_not_null":
        return col(name).isNotNull()
    text = to_text(col(name), schema[name].dataType)
    if op == "contains":
        found = text.contains(p["value"])
    elif op == "starts_with":
        found = text.startswith(p["value"])
    elif op == "ends_with":
        found = text.endswith(p["value"])
    elif op == "regex":
        found = text.rlike(p["pattern"] if "pattern" in p else p["value"])
    else:
        raise ValueError(f"unknown predicate: {op}")
    return F.coalesce(found, F.lit(False))


def predicate_columns(p: dict) -> set[str]:
    if p["op"] in ("and", "or"):
        return set().union(*map(predicate_columns, p["exprs"]))
    if p["op"] == "not":
        return predicate_columns(p["expr"])
    return {p["column"]}


# --- the one filter a viewer edits, column by column ----------------------


def _single(p: dict, column: str | None) -> bool:
    return p["op"] not in ("and", "or", "not") and p["column"] == column


def add_predicate(ops: list[dict], p: dict) -> list[dict]:
    """A condition joins the first filter; one on a single column replaces that column's other conditions."""
    column = p.get("column") if p["op"] not in ("and", "or", "not") else None
    for i, op in enumerate(ops):
        if op["type"] == "filter":
            parts = op["predicate"]["exprs"] if op["predicate"]["op"] == "and" else [op["predicate"]]
            rest = [x for x in parts if column is None or not _single(x, column)]
            merged = p if not rest and op["predicate"]["op"] != "and" else {"op": "and", "exprs": [*rest, p]}
            return [*ops[:i], {"type": "filter", "predicate": merged}, *ops[i + 1 :]]
    return [{"type": "filter", "predicate": p}, *ops]


def without_column(p: dict, column: str) -> dict | None:
    if p["op"] in ("and", "or"):
        left = [x for x in (without_column(y, column) for y in p["exprs"]) if x is not None]
        return None if not left else left[0] if len(left) == 1 else {"op": p["op"], "exprs": left}
    if p["op"] == "not":
        inner = without_column(p["expr"], column)
        return None if inner is None else {"op": "not", "expr": inner}
    return None if _single(p, column) else p


def remove_predicate(ops: list[dict], column: str) -> list[dict]:
    """Every condition on the column goes, and filters that become empty."""
    out = [op | {"predicate": without_column(op["predicate"], column)} if op["type"] == "filter" else op for op in ops]
    return [op for op in out if op["type"] != "filter" or op["predicate"] is not None]


def active_predicates(ops: list[dict]) -> list[dict]:
    p = next((op["predicate"] for op in ops if op["type"] == "filter"), None)
    return [] if p is None else p["exprs"] if p["op"] == "and" else [p]


def exclude_value(ops: list[dict], column: str, value) -> list[dict]:
    """Adds the value to the column's exclusions; its other conditions go."""
    held = next((p["values"] for p in active_predicates(ops) if p["op"] == "not_in" and p["column"] == column), [])
    return add_predicate(remove_predicate(ops, column), {"op": "not_in", "column": column, "values": [*held, value]})


def text_search(columns: list[str], text: str) -> dict:
    """Any of the columns contains the text."""
    return {"op": "or", "exprs": [{"op": "contains", "column": c, "value": text} for c in columns]}
