"""Code that computes a view elsewhere: DuckDB and ANSI SQL, Python (DuckDB, pandas, polars,
PySpark), a dbt model, and shell commands.

SQL is a chain of common table expressions, one an operation, in canonical order.  Each
step carries ``__place``, the row's place, so that first-row and limit semantics are
those of the engine.  A sample is of the same size but of other rows.
"""

from __future__ import annotations

import json
import math

from ..functions.scalars import argument
from .view import canonical

TARGETS = ("duckdb_sql", "ansi_sql", "pandas", "polars", "python_duckdb", "pyspark", "dbt", "shell", "shell_csv")

# SQL type names.
SQL_TYPES = {"int32": "INTEGER", "int64": "BIGINT", "float32": "REAL", "float64": "DOUBLE PRECISION", "text": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}


def name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return repr(v) if math.isfinite(v) else f"CAST('{v}' AS DOUBLE PRECISION)"
    return str(v) if isinstance(v, int) else text(v)


class Sql:
    def __init__(self, ansi: bool = False):
        self.ansi = ansi
        self.cast = "CAST" if ansi else "TRY_CAST"

    def number(self, x: str) -> str:
        return f"{self.cast}({x} AS DOUBLE PRECISION)"

    def compare(self, c: str, op: str, v) -> str:
        if v is None:
            return "FALSE"
        if isinstance(v, bool):
            return f"{self.cast}({c} AS BOOLEAN) {SIGNS[op]} {literal(v)}"
        if isinstance(v, (int, float)):
            return f"{self.number(c)} {SIGNS[op]} {literal(v)}"
        return f"CAST({c} AS VARCHAR) {SIGNS[op]} {text(v)}"

    def predicate(self, p: dict) -> str:
        op = p["op"]
        if op in ("and", "or"):
            parts = [f"({self.predicate(x)})" for x in p["exprs"]]
            return f" {op.upper()} ".join(parts) if parts else "TRUE" if op == "and" else "FALSE"
        if op == "not":
            return f"NOT ({self.predicate(p['expr'])})"
        c = name(p["column"])
        if op in SIGNS:
            return self.compare(c, op, p["value"])
        if op == "between":
            return f"{self.compare(c, 'gte', p['lo'])} AND {self.compare(c, 'lte', p['hi'])}"
        if op in ("in", "not_in"):
            any_of = " OR ".join(self.compare(c, "eq", v) for v in p["values"] if v is not None) or "FALSE"
            return any_of if op == "in" else f"NOT ({any_of})"
        if op in ("is_null", "is_not_null"):
            return f"{c} IS {'NOT ' if op == 'is_not_null' else ''}NULL"
        s, v = f"CAST({c} AS VARCHAR)", text(p.get("value", p.get("pattern", "")))
        if op == "regex":
            found = f"{s} SIMILAR TO {v}" if self.ansi else f"regexp_matches({s}, {v})"
        elif op == "contains":
            found = f"POSITION({v} IN {s}) > 0"
        elif op == "starts_with":
            found = f"SUBSTRING({s} FROM 1 FOR CHAR_LENGTH({v})) = {v}" if self.ansi else f"starts_with({s}, {v})"
        else:
            found = f"SUBSTRING({s} FROM CHAR_LENGTH({s}) - CHAR_LENGTH({v}) + 1) = {v}" if self.ansi else f"ends_with({s}, {v})"
        return f"COALESCE({found}, FALSE)"

    def order(self, keys: list[dict], names: list[str]) -> list[str]:
        return [f"{name(k['column'])} {'DESC' if k.get('descending') else 'ASC'} NULLS {'LAST' if k.get('nulls_last', True) else 'FIRST'}" for k in keys if k["column"] in names]

    def scalar(self, e: dict, names: list[str]) -> str:
        def go(x):
            return self.scalar(x, names)

        def num(x):
            return self.number(go(x))

        def txt(x):
            return f"CAST({go(x)} AS VARCHAR)"

        k = e["kind"]
        if k == "column":
            return name(e["name"])
        if k == "literal":
            return literal(e["value"])
        if k == "bin_op":
            a, b = num(e["left"]), num(e["right"])
            if e["op"] in ("div", "mod"):
                quotient = f"MOD({a}, {b})" if self.ansi and e["op"] == "mod" else f"{a} {ARITHMETIC[e['op']]} {b}"
                return f"CASE WHEN {a} IS NOT NULL AND {b} = 0 THEN CAST('NaN' AS DOUBLE PRECISION) ELSE {quotient} END"
            return f"({a} {ARITHMETIC[e['op']]} {b})"
        if k == "abs":
            return f"ABS({num(argument(e))})"
        if k == "round":
            v, scale = num(argument(e)), repr(10.0 ** e.get("decimals", 0))
            return f"(SIGN({v}) * FLOOR(ABS({v} * {scale}) + 0.5) / {scale})"
        if k in ("floor", "ceil"):
            return f"{k.upper()}({num(argument(e))})"
        if k in ("upper", "lower"):
            return f"{k.upper()}({txt(argument(e))})"
        if k == "trim":
            return f"TRIM({txt(argument(e))})" if self.ansi else rf"regexp_replace({txt(argument(e))}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
        if k == "length":
            return f"OCTET_LENGTH({txt(argument(e))})" if self.ansi else f"CAST(strlen({txt(argument(e))}) AS INTEGER)"
        if k == "substr":
            s, start, n = txt(e["expr"]), e["start"], e.get("len")
            if start < 0 or (n is not None and n < 0):
                return f"CASE WHEN {s} IS NOT NULL THEN '' END"
            return f"SUBSTRING({s} FROM {start + 1}{'' if n is None else f' FOR {n}'})" if self.ansi else f"substr({s}, {start + 1}{'' if n is None else f', {n}'})"
        if k == "concat":
            return "(" + " || ".join(map(txt, e["parts"])) + ")" if e["parts"] else "''"
        if k == "cast":
            inner, to = go(argument(e)), e["to_type"]
            if to in ("int32", "int64") and not self.ansi:
                return f"COALESCE(TRY_CAST(TRUNC(TRY_CAST({inner} AS DOUBLE)) AS {SQL_TYPES[to]}), TRY_CAST({inner} AS {SQL_TYPES[to]}))"
            return f"{self.cast}({inner} AS {SQL_TYPES[to]})"
        if k in ("year", "month", "day"):
            return f"CAST(EXTRACT({k.upper()} FROM {self.cast}({go(argument(e))} AS TIMESTAMP)) AS INTEGER)"
        if k == "coalesce":
            return f"COALESCE({', '.join(map(txt, e['exprs']))})" if e["exprs"] else "CAST(NULL AS VARCHAR)"
        if k == "case":
            whens = " ".join(f"WHEN {self.predicate(p)} THEN {txt(x)}" for p, x in e["whens"])
            other = txt(e["else_expr"]) if e.get("else_expr") is not None else "CAST(NULL AS VARCHAR)"
            return f"CASE {whens} ELSE {other} END" if whens else other
        by = ", ".join([*self.order(e.get("order", []), names), "__place"])
        row = f"ROW_NUMBER() OVER (ORDER BY {by})"
        if k == "rank":
            return row
        if e["n"] == 0:
            return "CAST(1 AS BIGINT)"
        return f"CAST(FLOOR(({row} - 1) * {e['n']} / CAST(COUNT(*) OVER () AS DOUBLE PRECISION)) AS BIGINT) + 1"

    def aggregate(self, a: dict) -> str:
        fn = a["fn"]
        if fn == "count":
            return "COUNT(*)"
        c = name(a["column"])
        v = self.number(c)
        if fn == "count_distinct":
            return f"COUNT(DISTINCT {c})"
        if fn in ("min", "max"):
            return f"{fn.upper()}({c})"
        if fn == "median":
            return f"PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY {v})" if self.ansi else f"median({v})"
        if fn == "percentile":
            return f"PERCENTILE_DISC({a['p'] / 100.0!r}) WITHIN GROUP (ORDER BY {v})" if self.ansi else f"list_sort(list({v}) FILTER ({v} IS NOT NULL))[CAST(FLOOR({a['p'] / 100.0!r} * (COUNT({v}) - 1) + 0.5) AS BIGINT) + 1]"
        return {"sum": "SUM", "mean": "AVG", "std_dev": "STDDEV_SAMP"}[fn] + f"({v})"

    def query(self, ops: list[dict], table: str, columns: list[str]) -> str:
        names, at, steps = list(columns), "s0", []
        order, is_sorted = ["__place"], False

        def cols(xs=None):
            return ", ".join(map(name, names if xs is None else xs))

        def step(body: str) -> None:
            nonlocal at
            at = f"s{len(steps)}"
            steps.append(f"{at} AS ({body})")

        step(f"SELECT {cols()}, ROW_NUMBER() OVER ({'ORDER BY 1' if self.ansi else ''}) - 1 AS __place FROM {table}")
        sample = None
        for op in canonical(ops):
            kind = op["type"]
            if kind == "approximate":
                sample = op["sample_rows"]
                continue
            if kind == "filter":
                step(f"SELECT * FROM {at} WHERE {self.predicate(op['predicate'])}")
            elif kind in ("select", "drop"):
                names = [c for c in op["columns"] if c in names] if kind == "select" else [c for c in names if c not in op["columns"]]
            elif kind == "derive":
                value = self.scalar(op["expr"], names)
                rest = [c for c in names if c != op["name"]]
                step(f"SELECT {cols(rest)}{', ' if rest else ''}{value} AS {name(op['name'])}, __place FROM {at}")
                names = names if op["name"] in names else [*names, op["name"]]
            elif kind == "deduplicate":
                keys = [c for c in (names if op.get("columns") is None else op["columns"]) if c in names]
                if keys:
                    step(f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {cols(keys)} ORDER BY __place) AS __first FROM {at}) AS t WHERE __first = 1")
            elif kind == "sample" or kind == "group_by" and sample is not None:
                n = op["n"] if kind == "sample" else sample
                step(f"SELECT * FROM {at} ORDER BY {'MOD(__place * 2654435761, 4294967296)' if self.ansi else 'hash(__place)'}, __place {self.first(n)}")
            if kind == "group_by":
                sample = None
                keys = op["keys"]
                aggs = [f"{self.aggregate(a)} AS {name(a['alias'])}" for a in op["aggs"]]
                by = ", ".join(f"{name(k)} ASC NULLS LAST" for k in keys)
                place = f"ROW_NUMBER() OVER (ORDER BY {by}) - 1 AS __place" if keys else "0 AS __place"
                step(f"SELECT {', '.join([*map(name, keys), *aggs, place])} FROM {at} " + (f"GROUP BY {cols(keys)}" if keys else "HAVING COUNT(*) > 0"))
                names, order, is_sorted = [*keys, *[a["alias"] for a in op["aggs"]]], ["__place"], True
            elif kind == "rename":
                to = {a: b for a, b in op["mappings"] if a in names}
                step(f"SELECT {', '.join(f'{name(c)} AS {name(to.get(c, c))}' for c in names)}, __place FROM {at}")
                names = [to.get(c, c) for c in names]
            if kind in ("sort", "top_k"):
                keys = self.order(op["keys"], names)
                order, is_sorted = ([*keys, "__place"], True) if keys else (order, is_sorted)
            if kind in ("limit", "top_k"):
                step(f"SELECT * FROM {at} ORDER BY {', '.join(order)} {self.first(op['n'])}")
        end = f"SELECT {cols()} FROM {at}" + (f" ORDER BY {', '.join(order)}" if is_sorted else "")
        return "WITH " + ",\n".join(steps) + "\n" + end

    def first(self, n: int) -> str:
        return f"FETCH FIRST {n} ROWS ONLY" if self.ansi else f"LIMIT {n}"


def scan(uri: str) -> str:
    low = uri.lower().split("?")[0]
    if low.endswith((".csv", ".tsv")):
        return f"read_csv_auto({text(uri)})"
    if low.endswith((".json", ".jsonl", ".ndjson")):
        return f"read_json_auto({text(uri)})"
    return f"read_parquet({text(uri)})"


def reader(module: str, uri: str) -> str:
    low = uri.lower().split("?")[0]
    if low.endswith((".csv", ".tsv")):
        tab = {"pd": 'sep="\\t"', "pl": 'separator="\\t"'}[module]
        return f"{module}.read_csv({uri!r}{', ' + tab if low.endswith('.tsv') else ''})"
    if low.endswith((".json", ".jsonl", ".ndjson")):
        return f"pd.read_json({uri!r}, lines=True)" if module == "pd" else f"pl.read_ndjson({uri!r})"
    return f"{module}.read_parquet({uri!r})"


def code(ops: list[dict], uri: str, columns: list[str], target: str) -> str:
    duck = Sql().query(ops, scan(uri), columns)
    if target == "duckdb_sql":
        return duck
    if target == "ansi_sql":
        return Sql(ansi=True).query(ops, name(uri.rsplit("/", 1)[-1].split(".")[0]), columns)
    if target == "python_duckdb":
        return f"import duckdb\n\nresult = duckdb.sql({duck!r}).df()\n"
    if target == "pyspark":
        steps = json.dumps(ops)
        return f"import json\n\nfrom gridloom.operators.pipeline import apply\nfrom gridloom.session import session\nfrom gridloom.sources.readers import open_source\n\nspark = session()\nsource, _ = open_source(spark, {uri!r})\nresult = apply(source, json.loads({steps!r}))\n"
    if target == "dbt":
        table = uri.rsplit("/", 1)[-1].split(".")[0]
        return "{{ config(materialized='view') }}\n\n" + Sql().query(ops, "{{ source('raw', '" + table + "') }}", columns) + "\n"
    if target in ("shell", "shell_csv"):
        flag = " -csv" if target == "shell_csv" else ""
        return f"duckdb{flag} -c '" + duck.replace("'", "'\\''") + "'\n"
    if target == "pandas":
        return f"import duckdb\nimport pandas as pd\n\nsource = {reader('pd', uri)}\n" + _frame_code(ops, columns)
    if target == "polars":
        return f"import duckdb\nimport polars as pl\n\nsource = {reader('pl', uri)}\n" + _frame_code(ops, columns).replace(".df()", ".pl()")
    raise ValueError(f"unknown target: {target}")


def _frame_code(ops: list[dict], columns: list[str]) -> str:
    """Frames are queried in place by DuckDB, so that all targets share one meaning."""
    return f"result = duckdb.sql({Sql().query(ops, 'source', columns)!r}).df()\n"
