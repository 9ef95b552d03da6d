"""Registered queries of the engine's own operators, each with independent DuckDB SQL.

``Q[name] = (callable, sql or None)``.  Every query reads whole tables.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates
from .operators import pipeline, profile, tiles
from .operators.ordinal import shared_folder
from .operators.pipeline import PLACE
from .plans import export
from .plans.view import View, canonical
from .sources import detect, footers, readers, sinks
from .sources.registry import Engine
from .streaming import apply_stream

Q: dict[str, tuple] = {}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return readers.read_parquet(spark, [f"{sf_dir}/{table}.parquet"])


def view(name: str, table: str, ops: list[dict], sql: str) -> None:
    Q[name] = (lambda spark, d: pipeline.apply(source(spark, d, table), ops), sql)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def op(kind: str, **kw) -> dict:
    return {"type": kind, **kw}


def key(column: str, descending: bool = False, nulls_last: bool = True) -> dict:
    return {"column": column, "descending": descending, "nulls_last": nulls_last}


def c(name: str) -> dict:
    return {"kind": "column", "name": name}


def v(value) -> dict:
    return {"kind": "literal", "value": value}


def count_where(name: str, table: str, p: dict, where: str) -> None:
    """Rows that a predicate keeps, by some of their columns."""
    view(name, table, [op("filter", predicate=p), op("group_by", keys=[], aggs=[{"fn": "count", "alias": "n"}])], f"SELECT count(*) AS n FROM {table} WHERE {where} HAVING count(*) > 0")


# --- predicates -----------------------------------------------------------

for _name, _sign in {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():
    count_where(f"pred_{_name}", "lineitem", {"op": _name, "column": "l_quantity", "value": 25}, f"l_quantity {_sign} 25")
count_where("pred_eq_text", "customer", {"op": "eq", "column": "c_mktsegment", "value": "BUILDING"}, "c_mktsegment = 'BUILDING'")
count_where("pred_gt_date", "orders", {"op": "gt", "column": "o_orderdate", "value": "1996-06-01"}, "o_orderdate >= TIMESTAMP '1996-06-01'")
count_where("pred_between", "part", {"op": "between", "column": "p_size", "lo": 10, "hi": 20}, "p_size BETWEEN 10 AND 20")
count_where("pred_in", "orders", {"op": "in", "column": "o_orderstatus", "values": ["F", "P", None]}, "o_orderstatus IN ('F', 'P')")
count_where("pred_not_in", "orders", {"op": "not_in", "column": "o_orderstatus", "values": ["F", None]}, "o_orderstatus NOT IN ('F')")
count_where("pred_contains", "documents", {"op": "contains", "column": "text", "value": "the "}, "contains(text, 'the ')")
count_where("pred_starts_with", "part", {"op": "starts_with", "column": "p_type", "value": "S"}, "starts_with(p_type, 'S')")
count_where("pred_ends_with", "part", {"op": "ends_with", "column": "p_name", "value": "1"}, "ends_with(p_name, '1')")
count_where("pred_regex", "pages", {"op": "regex", "column": "url", "value": "[0-9]{2,}"}, "regexp_matches(url, '[0-9]{2,}')")
count_where("pred_is_null", "events", {"op": "not", "expr": {"op": "is_null", "column": "value"}}, "NOT value IS NULL")
count_where("pred_is_not_null", "events", {"op": "is_not_null", "column": "props"}, "props IS NOT NULL")
count_where("pred_and", "lineitem", {"op": "and", "exprs": [{"op": "gt", "column": "l_quantity", "value": 10}, {"op": "lt", "column": "l_discount", "value": 0.05}]}, "l_quantity > 10 AND l_discount < 0.05")
count_where("pred_or", "lineitem", {"op": "or", "exprs": [{"op": "eq", "column": "l_returnflag", "value": "R"}, {"op": "gt", "column": "l_tax", "value": 0.07}]}, "l_returnflag = 'R' OR l_tax > 0.07")
count_where("pred_not", "lineitem", {"op": "not", "expr": {"op": "contains", "column": "l_returnflag", "value": "N"}}, "NOT contains(l_returnflag, 'N')")
count_where("pred_null_literal", "orders", {"op": "not", "expr": {"op": "eq", "column": "o_orderstatus", "value": None}}, "TRUE")
count_where("legacy_filter", "customer", {"op": "and", "exprs": [{"op": "gte", "column": "c_acctbal", "value": 0}, {"op": "contains", "column": "c_name", "value": "9"}]}, "c_acctbal >= 0 AND contains(c_name, '9')")

# --- scalar functions -----------------------------------------------------


def scalar(name: str, table: str, ident: str, expr: dict, sql: str, after: str = "") -> None:
    view(name, table, [op("derive", name="x", expr=expr), op("select", columns=[ident, "x"])], f"SELECT {ident}, {sql} AS x FROM {table} {after}")


def bin_op(o: str, a: dict, b: dict) -> dict:
    return {"kind": "bin_op", "op": o, "left": a, "right": b}


scalar("fn_column", "orders", "o_orderkey", c("o_orderstatus"), "o_orderstatus")
scalar("fn_literal", "orders", "o_orderkey", v("one"), "'one'")
scalar("fn_add", "orders", "o_orderkey", bin_op("add", c("o_custkey"), v(1)), "o_custkey::DOUBLE + 1")
scalar("fn_sub", "orders", "o_orderkey", bin_op("sub", c("o_custkey"), v(0.5)), "o_custkey::DOUBLE - 0.5::DOUBLE")
scalar("fn_mul", "orders", "o_orderkey", bin_op("mul", c("o_custkey"), c("o_orderkey")), "o_custkey::DOUBLE * o_orderkey::DOUBLE")
scalar("fn_div", "orders", "o_orderkey", bin_op("div", c("o_orderkey"), bin_op("add", c("o_custkey"), v(1))), "o_orderkey::DOUBLE / (o_custkey::DOUBLE + 1)")
scalar("fn_mod", "supplier", "s_suppkey", bin_op("mod", c("s_nationkey"), v(7)), "(s_nationkey % 7)::DOUBLE")
scalar("fn_div_zero", "supplier", "s_suppkey", {"kind": "cast", "expr": bin_op("div", c("s_suppkey"), v(0)), "to_type": "text"}, "'NaN'")
scalar("fn_abs", "supplier", "s_suppkey", {"kind": "abs", "0": c("s_acctbal")}, "abs(s_acctbal)")
scalar("fn_round", "supplier", "s_suppkey", {"kind": "round", "expr": c("s_acctbal"), "decimals": 0}, "sign(s_acctbal) * floor(abs(s_acctbal) + 0.5)")
scalar("fn_floor", "supplier", "s_suppkey", {"kind": "floor", "expr": c("s_acctbal")}, "floor(s_acctbal)")
scalar("fn_ceil", "supplier", "s_suppkey", {"kind": "ceil", "expr": c("s_acctbal")}, "ceil(s_acctbal)")
scalar("fn_upper", "documents", "doc_id", {"kind": "upper", "expr": c("source")}, "upper(source)")
scalar("fn_lower", "part", "p_partkey", {"kind": "lower", "expr": c("p_type")}, "lower(p_type)")
scalar("fn_trim", "customer", "c_custkey", {"kind": "trim", "expr": {"kind": "concat", "parts": [v(" \t"), c("c_name"), v("\n ")]}}, "c_name")
scalar("fn_length", "documents", "doc_id", {"kind": "length", "expr": c("text")}, "strlen(text)::INTEGER")
scalar("fn_substr", "documents", "doc_id", {"kind": "substr", "expr": c("text"), "start": 3, "len": 5}, "substr(text, 4, 5)")
scalar("fn_concat", "customer", "c_custkey", {"kind": "concat", "parts": [c("c_mktsegment"), v("/"), c("c_custkey")]}, "c_mktsegment || '/' || c_custkey")
scalar("fn_cast", "supplier", "s_suppkey", {"kind": "cast", "expr": c("s_acctbal"), "to_type": "int32"}, "trunc(s_acctbal)::INTEGER")
scalar("fn_cast_failed", "customer", "c_custkey", {"kind": "cast", "expr": c("c_name"), "to_type": "int64"}, "CAST(NULL AS BIGINT)")
for _part in ("year", "month", "day"):
    scalar(f"fn_{_part}", "orders", "o_orderkey", {"kind": _part, "expr": c("o_orderdate")}, f"{_part}(o_orderdate)::INTEGER")
scalar("fn_coalesce", "customer", "c_custkey", {"kind": "coalesce", "exprs": [{"kind": "cast", "expr": c("c_name"), "to_type": "int64"}, c("c_nationkey")]}, "c_nationkey::VARCHAR")
scalar("fn_case", "customer", "c_custkey", {"kind": "case", "whens": [[{"op": "lt", "column": "c_acctbal", "value": 0}, v("debt")], [{"op": "gt", "column": "c_acctbal", "value": 5000}, c("c_nationkey")]], "else_expr": None}, "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN c_nationkey::VARCHAR END")
scalar("fn_rank", "orders", "o_orderkey", {"kind": "rank", "order": [key("o_totalprice", True), key("o_orderkey")]}, "row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)")
view("fn_ntile", "orders", [op("derive", name="x", expr={"kind": "n_tile", "n": 7}), op("group_by", keys=["x"], aggs=[{"fn": "count", "alias": "n"}])], "SELECT x, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) * 7 // count(*) OVER () + 1 AS x FROM orders) GROUP BY x")

# --- aggregates -----------------------------------------------------------


def agg(name: str, a: dict, sql: str, table: str = "lineitem", keys: tuple = ("l_returnflag", "l_linestatus")) -> None:
    ks = ", ".join(keys)
    view(name, table, [op("group_by", keys=list(keys), aggs=[a | {"alias": "x"}])], f"SELECT {ks}{', ' if ks else ''}{sql} AS x FROM {table}" + (f" GROUP BY {ks}" if ks else ""))


agg("agg_count", {"fn": "count"}, "count(*)")
agg("agg_count_distinct", {"fn": "count_distinct", "column": "l_suppkey"}, "count(DISTINCT l_suppkey)")
agg("agg_sum", {"fn": "sum", "column": "l_quantity"}, "sum(l_quantity)")
agg("agg_min", {"fn": "min", "column": "l_extendedprice"}, "min(l_extendedprice)")
agg("agg_max", {"fn": "max", "column": "l_extendedprice"}, "max(l_extendedprice)")
agg("agg_median", {"fn": "median", "column": "l_extendedprice"}, "median(l_extendedprice)")
agg("agg_percentile", {"fn": "percentile", "column": "l_extendedprice", "p": 95}, "list_sort(list(l_extendedprice))[CAST(floor(0.95 * (count(l_extendedprice) - 1) + 0.5) AS BIGINT) + 1]")
agg("agg_min_text", {"fn": "min", "column": "l_shipdate"}, "min(l_shipdate)")
agg("global_agg", {"fn": "percentile", "column": "o_totalprice", "p": 50}, "list_sort(list(o_totalprice))[CAST(floor(0.5 * (count(o_totalprice) - 1) + 0.5) AS BIGINT) + 1]", "orders", ())


def rounded(name: str, fn: str, sql: str) -> None:
    view(name, "lineitem", [op("group_by", keys=["l_returnflag"], aggs=[{"fn": fn, "column": "l_extendedprice", "alias": "m"}])], "")
    f = Q[name][0]
    Q[name] = (lambda s, d: f(s, d).select("l_returnflag", F.round("m", 4).alias("m")), f"SELECT l_returnflag, round({sql}(l_extendedprice), 4) AS m FROM lineitem GROUP BY l_returnflag")


rounded("agg_mean", "mean", "avg")
rounded("agg_std_dev", "std_dev", "stddev_samp")
view("global_agg_empty", "orders", [op("filter", predicate={"op": "lt", "column": "o_orderkey", "value": -1}), op("group_by", keys=[], aggs=[{"fn": "count", "alias": "n"}])], "SELECT count(*) AS n FROM orders WHERE o_orderkey < -1 HAVING count(*) > 0")
view("agg_null_key", "customer", [op("derive", name="k", expr={"kind": "case", "whens": [[{"op": "gt", "column": "c_acctbal", "value": 0}, v("plus")]], "else_expr": None}), op("group_by", keys=["k"], aggs=[{"fn": "count", "alias": "n"}, {"fn": "percentile", "column": "c_acctbal", "p": 10, "alias": "p"}])], "SELECT k, count(*) AS n, list_sort(list(c_acctbal))[CAST(floor(0.1 * (count(c_acctbal) - 1) + 0.5) AS BIGINT) + 1] AS p FROM (SELECT CASE WHEN c_acctbal > 0 THEN 'plus' END AS k, c_acctbal FROM customer) GROUP BY k")
view("bitmap_group_count", "orders", [op("group_by", keys=["o_orderpriority"], aggs=[{"fn": "count", "alias": "n"}])], "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")

# --- pipeline operations --------------------------------------------------

view("filter", "customer", [op("filter", predicate={"op": "lt", "column": "c_acctbal", "value": 0})], "SELECT * FROM customer WHERE c_acctbal < 0")
view("select", "nation", [op("select", columns=["n_name", "nope", "n_nationkey"])], "SELECT n_name, n_nationkey FROM nation")
view("drop", "nation", [op("drop", columns=["n_regionkey", "nope"])], "SELECT n_nationkey, n_name FROM nation")
view("sort", "orders", [op("sort", keys=[key("o_orderpriority"), key("o_totalprice", True), key("o_orderkey")])], "SELECT * FROM orders")
view("derive", "lineitem", [op("derive", name="net", expr=bin_op("mul", c("l_extendedprice"), bin_op("sub", v(1), c("l_discount")))), op("filter", predicate={"op": "gt", "column": "net", "value": 50000}), op("group_by", keys=["l_returnflag"], aggs=[{"fn": "count", "alias": "n"}])], "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 GROUP BY l_returnflag")
view("dedup_all", "orders", [op("select", columns=["o_custkey", "o_orderstatus"]), op("deduplicate", columns=None)], "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
view("dedup_subset", "orders", [op("deduplicate", columns=["o_custkey"]), op("select", columns=["o_custkey", "o_orderkey"])], "SELECT o_custkey, arg_min(o_orderkey, r) AS o_orderkey FROM (SELECT *, row_number() OVER () AS r FROM orders) GROUP BY o_custkey")
view("group_by", "lineitem", [op("filter", predicate={"op": "gt", "column": "l_quantity", "value": 10}), op("group_by", keys=["l_returnflag", "l_linestatus"], aggs=[{"fn": "count", "alias": "n"}, {"fn": "sum", "column": "l_quantity", "alias": "sum_qty"}])], "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
view("rename", "region", [op("rename", mappings=[["r_regionkey", "r_name"], ["r_name", "r_regionkey"], ["nope", "x"]])], "SELECT r_regionkey AS r_name, r_name AS r_regionkey FROM region")
view("limit", "orders", [op("limit", n=100)], "SELECT * FROM (SELECT *, row_number() OVER () AS r FROM orders) WHERE r <= 100")
Q["limit"] = (Q["limit"][0], "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER () AS r FROM orders) WHERE r <= 100")
view("top_k", "orders", [op("top_k", n=50, keys=[key("o_totalprice", True), key("o_orderkey")])], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
view("sort_limit", "orders", [op("sort", keys=[key("o_totalprice"), key("o_orderkey")]), op("limit", n=50)], "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
view("group_sort_limit", "orders", [op("group_by", keys=["o_custkey"], aggs=[{"fn": "count", "alias": "n"}]), op("sort", keys=[key("n", True), key("o_custkey")]), op("limit", n=20)], "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
view("filter_aggregate", "orders", [op("group_by", keys=["o_custkey"], aggs=[{"fn": "count", "alias": "n"}]), op("filter", predicate={"op": "gt", "column": "n", "value": 15})], "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
view("select_then_filter", "customer", [op("select", columns=["c_custkey"]), op("filter", predicate={"op": "gt", "column": "c_acctbal", "value": 9000})], "SELECT c_custkey FROM customer WHERE c_acctbal > 9000")


@query("sample", "SELECT least(500, count(*)) AS n, least(500, count(*)) AS distinct_keys, true AS same FROM orders")
def _sample(spark, d):
    """An exact number of rows, the same ones each time."""
    one, two = (pipeline.apply(source(spark, d, "orders"), [op("sample", n=500, strategy="bernoulli", seed=7)]).select("o_orderkey") for _ in range(2))
    both = one.join(two, "o_orderkey").agg(F.count("*").alias("m"))
    return one.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys")).join(both).select("n", "distinct_keys", (F.col("n") == F.col("m")).alias("same"))


@query("approximate", "SELECT least(1000, count(*)) AS n FROM orders")
def _approximate(spark, d):
    ops = [op("approximate", sample_rows=1000, seed=1), op("group_by", keys=["o_orderstatus"], aggs=[{"fn": "count", "alias": "n"}])]
    return pipeline.apply(source(spark, d, "orders"), ops).agg(F.sum("n").alias("n"))


Q["approx_agg"] = Q["approximate"]


@query("normalize", "SELECT * FROM (VALUES ('approximate,select,drop,filter,derive,deduplicate,sample,group_by,rename,sort,limit')) AS t(kinds)")
def _normalize(spark, d):
    ops = [op("limit", n=1), op("sort", keys=[]), op("rename", mappings=[]), op("group_by", keys=[], aggs=[]), op("deduplicate", columns=None), op("sample", n=1), op("derive", name="x", expr=v(1)), op("filter", predicate={"op": "is_null", "column": "y"}), op("drop", columns=[]), op("select", columns=["y"]), op("approximate", sample_rows=1)]
    return spark.createDataFrame([(",".join(o["type"] for o in canonical(ops)),)], "kinds string")


# --- scans ----------------------------------------------------------------


@query("scan_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def _scan(spark, d):
    return readers.read_parquet(spark, [f"{d}/lineitem.parquet"], place=False).select("l_orderkey", "l_quantity")


view("scan_parquet_filtered", "lineitem", [op("filter", predicate={"op": "gt", "column": "l_quantity", "value": 49}), op("select", columns=["l_orderkey", "l_quantity"])], "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")


@query("scan_parquet_tile", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER () - 1 AS r FROM orders) WHERE r >= 300 AND r < 556")
def _scan_tile(spark, d):
    return tiles.source_tile(source(spark, d, "orders"), 300, 0, 256, 2)


FILTERED = [op("filter", predicate={"op": "eq", "column": "o_orderstatus", "value": "F"})]


@query("scan_filtered_tile", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY r0) - 1 AS r FROM (SELECT *, row_number() OVER () AS r0 FROM orders) WHERE o_orderstatus = 'F') WHERE r >= 100 AND r < 200")
def _filtered_tile(spark, d):
    return tiles.tile(pipeline.run(source(spark, d, "orders"), FILTERED), 100, 0, 100, 2)


@query("scan_filtered_tile_indexed", Q["scan_filtered_tile"][1])
def _filtered_tile_indexed(spark, d):
    engine = Engine(spark)
    s = engine.register(f"{d}/orders.parquet")
    return engine.tiles(View(s.id, FILTERED), [(100, 0, 100, 2)])[0]


@query("count_filtered", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _count_filtered(spark, d):
    return source(spark, d, "orders").filter(predicates.compile_predicate(FILTERED[0]["predicate"], source(spark, d, "orders").schema)).agg(F.count("*").alias("n"))


def written(spark, df: DataFrame, how, read) -> DataFrame:
    """Rows after a round trip through a sink, in a folder all executors share."""
    top = shared_folder(spark, "io")
    how(df, top)
    return read(top)


@query("scan_multi_file", "SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier")
def _multi(spark, d):
    return readers.read_parquet(spark, [f"{d}/supplier.parquet"] * 2, place=False).select("s_suppkey")


@query("scan_glob", "SELECT r_name, n FROM (SELECT r_name, 1 AS n FROM region)")
def _glob(spark, d):
    files = readers.expand(f"{d}/regio*.parquet") if "://" not in d else [f"{d}/region.parquet"]
    return readers.read_parquet(spark, files, place=False).select("r_name", F.lit(1).alias("n"))


def several(spark, d) -> str:
    """The orders as a folder of files in the order of their keys."""
    out: list[str] = []

    def write(df, p):
        sinks.write_parquet(df.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey"), p, "overwrite")
        out.append(p)

    written(spark, spark.read.parquet(f"{d}/orders.parquet"), write, lambda p: None)
    return out[0] if "://" in out[0] else f"file://{out[0]}"


_MIDDLE = "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r >= n // 2 AND r < n // 2 + 256"


@query("folder_tile", _MIDDLE)
def _folder_tile(spark, d):
    """A tile in the middle of a table of several files, by URI."""
    engine = Engine(spark)
    s = engine.register(several(spark, d))
    return engine.tile(View(s.id), engine.count(View(s.id)) // 2).select("o_orderkey", "o_custkey")


@query("folder_search", "SELECT r AS row_id FROM (SELECT o_orderpriority AS t, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE contains(t, '1-URGENT') ORDER BY r LIMIT 100")
def _folder_search(spark, d):
    engine = Engine(spark)
    s = engine.register(several(spark, d))
    return tiles.search(s.df, "1-URGENT", ["o_orderpriority"])


@query("folder_dedup", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _folder_dedup(spark, d):
    """The first row of each customer, in the order of several files."""
    engine = Engine(spark)
    s = engine.register(several(spark, d))
    return engine.query(View(s.id, [op("select", columns=["o_custkey", "o_orderkey"]), op("deduplicate", columns=["o_custkey"])]))


@query("csv_search", "SELECT r AS row_id FROM (SELECT o_orderpriority AS t, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE contains(t, '2-HIGH') ORDER BY r LIMIT 100")
def _csv_search(spark, d):
    def write(df, p):
        df.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.mode("overwrite").option("header", True).csv(p)

    return written(spark, spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), write, lambda p: tiles.search(readers.numbered(readers.read_csv(spark, p)), "2-HIGH", ["o_orderpriority"]))


@query("sink_parquet", "SELECT * FROM nation")
def _sink_parquet(spark, d):
    return written(spark, source(spark, d, "nation").drop(PLACE), lambda df, p: sinks.write_parquet(df, p, "overwrite"), spark.read.parquet)


@query("sink_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _sink_csv(spark, d):
    return written(spark, source(spark, d, "nation").drop(PLACE), lambda df, p: sinks.write_csv(df, p, "overwrite"), lambda p: readers.read_csv(spark, p))


Q["scan_csv"] = Q["sink_csv"]


@query("sink_jsonl", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"none\":null}' AS value FROM region")
def _sink_jsonl(spark, d):
    df = source(spark, d, "region").drop(PLACE).withColumn("none", F.lit(float("nan")))
    return written(spark, df, lambda x, p: sinks.write_jsonl(x, p, "overwrite"), spark.read.text)


@query("scan_json", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _scan_json(spark, d):
    df = source(spark, d, "region").drop(PLACE)
    return written(spark, df, lambda x, p: sinks.write_jsonl(x, p, "overwrite"), lambda p: readers.read_json(spark, p)).select("r_regionkey", "r_name")


@query("sink_arrow", "SELECT * FROM region")
def _sink_arrow(spark, d):
    import pyarrow as pa

    return spark.createDataFrame(pa.ipc.open_stream(sinks.arrow_stream(source(spark, d, "region").drop(PLACE))).read_all())


@query("scan_arrow", "SELECT * FROM nation")
def _scan_arrow(spark, d):
    import pyarrow as pa

    t = source(spark, d, "nation").drop(PLACE).toArrow()
    with tempfile.TemporaryDirectory() as top:
        with pa.ipc.new_file(f"{top}/n.arrow", t.schema) as w:
            w.write_table(t)
        return readers.read_arrow(spark, f"{top}/n.arrow").drop(PLACE)


@query("upload", "SELECT * FROM region")
def _upload(spark, d):
    engine = Engine(spark)
    s = engine.upload(source(spark, d, "region").drop(PLACE).toPandas(), "region")
    return engine.query(View(s.id))


@query("rewrite_optimize", "SELECT * FROM supplier")
def _rewrite(spark, d):
    return written(spark, source(spark, d, "supplier").drop(PLACE), lambda df, p: (shutil.rmtree(p, ignore_errors=True), sinks.rewrite(df, p)), spark.read.parquet)


@query("scan_delta", "SELECT r_regionkey, r_name FROM region")
def _delta(spark, d):
    top = tempfile.mkdtemp(prefix="gridloom-delta-")
    atexit.register(shutil.rmtree, top, True)
    os.makedirs(f"{top}/_delta_log")
    shutil.copy(f"{d}/region.parquet", f"{top}/a.parquet")
    shutil.copy(f"{d}/region.parquet", f"{top}/b.parquet")
    logs = [[{"add": {"path": "a.parquet"}}, {"add": {"path": "b.parquet"}}], [{"remove": {"path": "a.parquet"}}]]
    for i, actions in enumerate(logs):
        with open(f"{top}/_delta_log/{i:020}.json", "w", encoding="utf-8") as f:
            f.write("\n".join(map(json.dumps, actions)))
    return readers.open_source(spark, f"delta://{top}", place=False)[0]


@query("scan_iceberg", "SELECT r_regionkey, r_name FROM region")
def _iceberg(spark, d):
    top = tempfile.mkdtemp(prefix="gridloom-iceberg-")
    atexit.register(shutil.rmtree, top, True)
    files = {"meta.json": {"current-snapshot-id": 2, "snapshots": [{"snapshot-id": 1}, {"snapshot-id": 2, "manifest-list": "list.json"}]}, "list.json": [{"manifest_path": "m.json"}], "m.json": [{"status": 1, "data_file": {"file_path": os.path.abspath(f"{d}/region.parquet")}}, {"status": 2, "data_file": {"file_path": "/gone.parquet"}}]}
    for k, x in files.items():
        with open(f"{top}/{k}", "w", encoding="utf-8") as f:
            json.dump(x, f)
    return readers.open_source(spark, f"iceberg://{top}/meta.json", place=False)[0]


@query("detect", "SELECT * FROM (VALUES ('s3://b/x.parquet', 's3', 'parquet', 'x'), ('gs://b/y.csv', 'gcs', 'csv', 'y'), ('abfs://c/z.tsv', 'azure_blob', 'csv', 'z'), ('delta:///t', 'delta', 'delta', 't'), ('iceberg:///m.json', 'iceberg', 'iceberg', 'm'), ('mysql://h/d', 'mysql', 'database', 'd'), ('https://h/a.ndjson?k=1', 'http', 'json', 'a'), ('/a/b.feather', 'local_file', 'arrow', 'b'), ('hf://datasets/o/n', 'hugging_face', 'parquet', 'n')) AS t(uri, kind, format, name)")
def _detect(spark, d):
    uris = ["s3://b/x.parquet", "gs://b/y.csv", "abfs://c/z.tsv", "delta:///t", "iceberg:///m.json", "mysql://h/d", "https://h/a.ndjson?k=1", "/a/b.feather", "hf://datasets/o/n"]
    return spark.createDataFrame([(u, detect.detect_kind(u), detect.detect_format(u), detect.infer_name(u)) for u in uris], "uri string, kind string, format string, name string")


@query("register", "SELECT 'nation' AS name, 3 AS n_cols, 25 AS n_rows, 0 AS left_over")
def _register(spark, d):
    engine = Engine(spark)
    s = engine.register(f"{d}/nation.parquet")
    out = (s.name, len(s.columns), engine.count(View(s.id)))
    engine.remove(s.id)
    return spark.createDataFrame([(*out, len(engine.registered()))], "name string, n_cols int, n_rows int, left_over int")


@query("browse_catalog", "SELECT 'gridloom_region' AS name")
def _browse(spark, d):
    source(spark, d, "region").drop(PLACE).createOrReplaceTempView("gridloom_region")
    return spark.createDataFrame([(t["name"],) for t in Engine(spark).browse() if t["name"] == "gridloom_region"], "name string")


def grouped(spark, d) -> list[str]:
    """The orders in the order of their keys, as one file with row groups of 400 rows."""
    out: list[str] = []

    def write(df, p):
        df.coalesce(1).sortWithinPartitions("o_orderkey").write.option("parquet.block.row.count.limit", 400).parquet(p)
        out.extend(readers.expand(f"{p.removeprefix('file://')}/*.parquet"))

    written(spark, spark.read.parquet(f"{d}/orders.parquet"), write, lambda p: None)
    return out


@query("recommendations", "SELECT 'small_row_groups' AS recommendation FROM orders HAVING count(*) > 400 UNION ALL SELECT 'no_bloom_filters' FROM orders HAVING count(*) > 0")
def _recommendations(spark, d):
    """Small row groups and no Bloom filters are found, statistics aren't missing."""
    return spark.createDataFrame([(x,) for x in footers.recommendations(grouped(spark, d))], "recommendation string")


@query("footer_row_groups", "SELECT r // 400 AS rg_index, min(r) AS row_offset, count(*) AS row_count, min(o_orderkey) AS min, max(o_orderkey) AS max FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) GROUP BY r // 400")
def _footer_row_groups(spark, d):
    got = footers.row_group_stats(grouped(spark, d), "o_orderkey")
    return spark.createDataFrame([tuple(g[k] for k in ("rg_index", "row_offset", "row_count", "min", "max")) for g in got], "rg_index long, row_offset long, row_count long, min long, max long")


@query("detect_pre_sorted", "SELECT 0 AS n_keys")
def _pre_sorted(spark, d):
    return spark.createDataFrame([(len(footers.sorted_by([f"{d}/orders.parquet"])),)], "n_keys int")


@query("pre_sorted_file", "SELECT 'n_regionkey' AS \"column\", true AS descending, false AS nulls_last, count(*) AS n_rows FROM nation UNION ALL SELECT 'n_name', false, true, count(*) FROM nation")
def _pre_sorted_file(spark, d):
    """The sort keys that a file's row groups declare."""
    import pyarrow.parquet as pq

    t = spark.read.parquet(f"{d}/nation.parquet").orderBy(F.desc("n_regionkey"), "n_name").toArrow()
    names = t.column_names
    with tempfile.TemporaryDirectory() as top:
        keys = [pq.SortingColumn(names.index("n_regionkey"), descending=True, nulls_first=True), pq.SortingColumn(names.index("n_name"), descending=False, nulls_first=False)]
        pq.write_table(t, f"{top}/n.parquet", sorting_columns=keys, row_group_size=10)
        found, n = footers.sorted_by([f"{top}/n.parquet"]), footers.row_count([f"{top}/n.parquet"])
    return spark.createDataFrame([(k["column"], k["descending"], k["nulls_last"], n) for k in found], "column string, descending boolean, nulls_last boolean, n_rows long")


# --- profiles -------------------------------------------------------------


@query("quick_stats", "SELECT 'o_orderkey' AS \"column\", count(*) - count(o_orderkey) AS null_count, min(o_orderkey)::VARCHAR AS min_value, max(o_orderkey)::VARCHAR AS max_value FROM orders UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders")
def _quick(spark, d):
    return profile.quick_stats(source(spark, d, "orders").select("o_orderkey", "o_orderstatus")).drop("data_type")


@query("footer_stats", "SELECT 'o_orderkey' AS \"column\", min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM orders")
def _footer(spark, d):
    got = footers.quick_stats([f"{d}/orders.parquet"])["o_orderkey"]
    return spark.createDataFrame([("o_orderkey", float(got["min"]), float(got["max"]))], "column string, lo double, hi double")


_STATS = "SELECT '{c}' AS \"column\", count(*) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS \"distinct\", {m} AS mean FROM {t}"


@query("col_stats", " UNION ALL ".join([_STATS.format(c="l_quantity", m="round(avg(l_quantity), 6)", t="lineitem"), _STATS.format(c="l_returnflag", m="CAST(NULL AS DOUBLE)", t="lineitem")]))
def _col_stats(spark, d):
    return profile.column_stats(source(spark, d, "lineitem"), ["l_quantity", "l_returnflag"], exact=True, points=False).select("column", "count", "null_count", "distinct", F.round("mean", 6).alias("mean"))


_CLASS = (
    "SELECT '{c}' AS \"column\", d AS \"distinct\", CASE WHEN d = 0 OR n = 0 THEN 'unknown' WHEN d = 1 THEN 'constant' WHEN d = 2 THEN 'binary' WHEN d <= 20 THEN 'low_cardinality' "
    "WHEN d <= sqrt(n) THEN 'categorical' WHEN d >= 0.95 * n THEN 'unique' ELSE 'high_cardinality' END AS cardinality FROM (SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM customer)"
)
_CLASSED = ["c_custkey", "c_nationkey", "c_mktsegment", "c_name"]


@query("profile", " UNION ALL ".join(_CLASS.format(c=c) for c in _CLASSED))
def _profile(spark, d):
    return profile.column_stats(source(spark, d, "customer"), _CLASSED, exact=True, points=False).select("column", "distinct", "cardinality")


@query("col_stats_coarse", "SELECT least(8192, count(*)) AS count FROM lineitem")
def _coarse(spark, d):
    return profile.column_stats_coarse(source(spark, d, "lineitem"), ["l_tax"]).select("count")


@query("distinct_approx", "SELECT true AS near FROM lineitem LIMIT 1")
def _distinct(spark, d):
    df = source(spark, d, "lineitem")
    sketch = profile.column_stats(df, ["l_partkey"]).select(F.col("distinct").alias("a"))
    exact = df.agg(F.count_distinct("l_partkey").alias("b"))
    return sketch.join(exact).select((F.abs(F.col("a") - F.col("b")) <= 0.05 * F.col("b")).alias("near"))


_HIST = "SELECT bucket, count(*) AS count FROM (SELECT least(CAST(floor((v - a) / ((b - a) / 50)) AS INTEGER), 49) AS bucket FROM (SELECT o_totalprice AS v FROM orders), (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)) GROUP BY bucket"


@query("histogram", _HIST)
def _histogram(spark, d):
    return profile.histogram(source(spark, d, "orders"), "o_totalprice").select("bucket", "count")


@query("quantiles", "SELECT list_sort(list(o_totalprice))[ceil(0.5 * count(*))::INT] AS p50, list_sort(list(o_totalprice))[ceil(0.95 * count(*))::INT] AS p95 FROM orders")
def _quantiles(spark, d):
    return profile.column_stats(source(spark, d, "orders"), ["o_totalprice"], exact=True).select("p50", "p95")


@query("top_values", "SELECT event_type AS value, count(*) AS count, count(*) / (SELECT count(*) FROM events) AS rate FROM events GROUP BY event_type ORDER BY count DESC, value LIMIT 10")
def _top(spark, d):
    return profile.top_values(source(spark, d, "events"), "event_type")


@query("cardinality", "SELECT * FROM (VALUES (0, 10, 'unknown'), (1, 10, 'constant'), (2, 100, 'binary'), (20, 100, 'low_cardinality'), (30, 10000, 'categorical'), (100, 100, 'unique'), (500, 1000, 'high_cardinality'), (1, 0, 'unknown')) AS t(d, n, class)")
def _cardinality(spark, d):
    rows = spark.createDataFrame([(0, 10), (1, 10), (2, 100), (20, 100), (30, 10000), (100, 100), (500, 1000), (1, 0)], "d int, n int")
    return rows.select("d", "n", profile.cardinality(F.col("d"), F.col("n")).alias("class"))


@query("correlations", "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', 1 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1")
def _correlations(spark, d):
    return profile.correlations(source(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 6))


@query("row_group_stats", "SELECT CAST(min(r) AS BIGINT) AS row_offset, count(*) AS row_count, min(o_orderkey)::DOUBLE AS min, max(o_orderkey)::DOUBLE AS max FROM (SELECT *, row_number() OVER () - 1 AS r FROM orders) GROUP BY r // 1000")
def _blocks(spark, d):
    return profile.block_stats(source(spark, d, "orders"), "o_orderkey", 1000).select("row_offset", "row_count", "min", "max")


@query("tile_agg", "SELECT avg(o_totalprice) AS o_totalprice_mean, 0.0::DOUBLE AS o_totalprice_null_pct, 0 AS o_totalprice_type_char, 0.0::DOUBLE AS o_orderstatus_mean, 0.0::DOUBLE AS o_orderstatus_null_pct, 1 AS o_orderstatus_type_char FROM (SELECT *, row_number() OVER () AS r FROM orders) WHERE r <= 256")
def _tile_agg(spark, d):
    f = tiles.source_tile(source(spark, d, "orders"))
    return tiles.tile_summary(f.select("o_totalprice", "o_orderstatus"))


@query("search", "SELECT r AS row_id FROM (SELECT p_name, p_type, p_brand, row_number() OVER () - 1 AS r FROM part) WHERE contains(p_name, '12') OR contains(p_type, '12') OR contains(p_brand, '12') ORDER BY r LIMIT 100")
def _search(spark, d):
    return tiles.search(source(spark, d, "part"), "12", ["p_name", "p_type", "p_brand"])


_LANDMARKS = (
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), b AS (SELECT r // 256 AS b, count(*) AS n, count(*) FILTER (r % 700 = 600) AS odd FROM o GROUP BY b) "
    "SELECT b * 256 AS row_offset, n AS row_count, 'outlier' AS type, 1.0 AS severity, 'price' AS columns FROM b WHERE odd > 0 UNION ALL SELECT b * 256, n, 'null_surge', 0.75, 'a,b,c' FROM b WHERE b = 2"
)


@query("landmarks", _LANDMARKS)
def _landmarks(spark, d):
    """Blocks of 256 rows, some with a price far out, one with three columns null."""
    held = Engine(spark).register(several(spark, d)).df
    r = F.col(PLACE)
    price = F.when(r % 700 == 600, F.lit(6000.0)).otherwise(1000.0 + r % 100)
    gone = [F.when(F.floor(r / 256) != 2, F.lit("x")).alias(c) for c in "abc"]
    return profile.landmarks(held.select(price.alias("price"), *gone, PLACE), 256).withColumn("columns", F.concat_ws(",", "columns"))


@query("outlier_class", "SELECT s_suppkey, CASE WHEN s_acctbal > 9000 THEN 'high' WHEN s_acctbal < 0 THEN 'low' ELSE 'none' END AS class, greatest(0, least(1, s_acctbal / 9000)) AS level FROM supplier")
def _outlier(spark, d):
    x = F.col("s_acctbal")
    return source(spark, d, "supplier").select("s_suppkey", profile.outlier_class(x, F.lit(0.0), F.lit(9000.0)).alias("class"), profile.normalise(x, F.lit(0.0), F.lit(9000.0)).alias("level"))


# --- tiles, views and code ------------------------------------------------

SORTED = [op("filter", predicate={"op": "gt", "column": "o_totalprice", "value": 1000}), op("sort", keys=[key("o_totalprice", True), key("o_orderkey")])]


@query("view_tile", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 256 OFFSET 512")
def _view_tile(spark, d):
    return tiles.tile(pipeline.run(source(spark, d, "orders"), SORTED), 512, 0, 256, 3)


@query("legacy_tile", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 ORDER BY c_custkey DESC LIMIT 50 OFFSET 10")
def _legacy_tile(spark, d):
    return tiles.legacy_tile(source(spark, d, "customer"), {"op": "gte", "column": "c_acctbal", "value": 0}, {"column": "c_custkey", "descending": True}, 10, 0, 50, 2)


@query("view_tile_batch", "SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 100)")
def _batch(spark, d):
    engine = Engine(spark)
    s = engine.register(f"{d}/orders.parquet")
    a, b = engine.tiles(View(s.id, SORTED), [(0, 0, 10, 1), (100, 0, 10, 1)])
    return a.union(b)


@query("view_count", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")
def _view_count(spark, d):
    f = pipeline.run(source(spark, d, "orders"), [op("select", columns=["o_custkey"]), op("deduplicate", columns=None)])
    return f.shown.agg(F.count("*").alias("n"))


@query("view_schema", "SELECT * FROM (VALUES (0, 'o_orderstatus', 'Utf8'), (1, 'n', 'Int64'), (2, 'm', 'Float64')) AS t(\"index\", name, data_type)")
def _view_schema(spark, d):
    f = pipeline.run(source(spark, d, "orders"), [op("group_by", keys=["o_orderstatus"], aggs=[{"fn": "count", "alias": "n"}, {"fn": "mean", "column": "o_totalprice", "alias": "m"}])])
    return spark.createDataFrame([(x["index"], x["name"], x["data_type"]) for x in tiles.view_schema(f)], "index int, name string, data_type string")


@query("view_download", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < -500")
def _download(spark, d):
    ops = [op("filter", predicate={"op": "lt", "column": "c_acctbal", "value": -500}), op("select", columns=["c_custkey", "c_name"])]
    return written(spark, pipeline.apply(source(spark, d, "customer"), ops), lambda df, p: sinks.write(df, p, "parquet", "overwrite"), spark.read.parquet)


@query("inspect", "SELECT count(*) AS n_rows, 6 AS n_cols FROM part")
def _inspect(spark, d):
    got = Engine(spark).inspect(f"{d}/part.parquet")
    return spark.createDataFrame([(got["rows"], len(got["columns"]))], "n_rows long, n_cols int")


@query("tile_math", "SELECT * FROM (VALUES (256, 64, 256, 256, 44, 36, 4)) AS t(rows1, cols1, row, col, rows, cols, visible)")
def _tile_math(spark, d):
    row, column, rows, cols = tiles.tile_range(1, 4, 300, 292)
    return spark.createDataFrame([(tiles.tile_rows_at(1), tiles.tile_cols_at(1), row, column, rows, cols, len(tiles.visible_tiles(0, 0, 1500, 6000, 20, 20)))], "rows1 int, cols1 int, row int, col int, rows int, cols int, visible int")


@query("view_hash", "SELECT '09612b07b5ecb5a5' AS hash")
def _view_hash(spark, d):
    return spark.createDataFrame([(View("s", []).key(),)], "hash string")


CHAIN = [op("derive", name="net", expr=bin_op("mul", c("l_extendedprice"), c("l_quantity"))), op("filter", predicate={"op": "gt", "column": "net", "value": 1000}), op("group_by", keys=["l_returnflag"], aggs=[{"fn": "count", "alias": "n"}, {"fn": "percentile", "column": "net", "p": 90, "alias": "p90"}, {"fn": "max", "column": "l_tax", "alias": "t"}]), op("rename", mappings=[["l_returnflag", "flag"]]), op("sort", keys=[key("n", True)]), op("limit", n=2)]
COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: The oracle of this query is what the exporter writes.
Q["code_duckdb"] = (lambda spark, d: pipeline.apply(source(spark, d, "lineitem"), CHAIN), export.Sql().query(CHAIN, "lineitem", COLUMNS))


@query("code_export", "SELECT unnest(['duckdb_sql', 'ansi_sql', 'pandas', 'polars', 'python_duckdb', 'pyspark', 'dbt', 'shell', 'shell_csv']) AS target, true AS made")
def _code(spark, d):
    return spark.createDataFrame([(t, bool(export.code(CHAIN, f"{d}/lineitem.parquet", COLUMNS, t))) for t in export.TARGETS], "target string, made boolean")


@query("predicate_merge", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_nationkey NOT IN (3, 4)")
def _merge(spark, d):
    ops = predicates.add_predicate([], {"op": "gt", "column": "c_acctbal", "value": 100})
    ops = predicates.add_predicate(ops, {"op": "gt", "column": "c_acctbal", "value": 5000})
    ops = predicates.exclude_value(predicates.exclude_value(ops, "c_nationkey", 3), "c_nationkey", 4)
    return pipeline.apply(source(spark, d, "customer"), ops).agg(F.count("*").alias("n"))


count_where("text_search", "part", predicates.text_search(["p_name", "p_brand"], "3"), "contains(p_name, '3') OR contains(p_brand, '3')")
view("value_counts", "events", [op("group_by", keys=["event_type"], aggs=[{"fn": "count", "alias": "count"}]), op("sort", keys=[key("count", True)])], "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")


@query("stream_view")
def _stream(spark, d):
    """A streaming read of a table through a stateless view and a running count, run to its end."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    out = apply_stream(stream, [op("filter", predicate={"op": "gt", "column": "value", "value": 0}), op("group_by", keys=["event_type"], aggs=[{"fn": "count", "alias": "n"}])])
    name = f"gridloom_stream_{abs(hash(d))}"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


Q["stream_view"] = (Q["stream_view"][0], "SELECT event_type, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")

QUERIES = {k: f for k, (f, _) in Q.items()}
ORACLES = {k: s for k, (_, s) in Q.items() if s}
