"""The engine's rules on small fixtures: nulls, casts, order, first rows, pushdown, code."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.functions import predicates
from gridloom.operators import pipeline, profile, tiles
from gridloom.operators.pipeline import PLACE, apply
from gridloom.plans import export
from gridloom.plans.view import View, canonical
from gridloom.sources import readers, sinks
from gridloom.sources.registry import Engine
from gridloom.streaming import apply_stream

from .helpers import DATA, connect, same


def op(kind, **kw):
    return {"type": kind, **kw}


def c(name):
    return {"kind": "column", "name": name}


def v(x):
    return {"kind": "literal", "value": x}


@pytest.fixture(scope="module")
def nullable(spark):
    rows = [(i, None if i % 3 == 0 else f"item_{i}", None if i % 3 == 0 else i * 1.1, None if i % 3 == 0 else i % 2 == 0) for i in range(20)]
    return spark.createDataFrame(rows, "id long, name string, score double, flag boolean").coalesce(1)


@pytest.fixture(scope="module")
def people(spark):
    rows = [("alice", 10), ("bob", 20), ("charlie", 30), ("alice", 40)]
    return spark.createDataFrame(rows, "name string, val long").coalesce(1)


def kept(df, p):
    return [r.id for r in apply(df, [op("filter", predicate=p)]).orderBy("id").collect()]


def test_null_rules(nullable):
    base = {"column": "name", "value": "item"}
    assert len(kept(nullable, {"op": "starts_with"} | base)) == 13
    assert len(kept(nullable, {"op": "not", "expr": {"op": "starts_with"} | base})) == 7  # null rows stay
    assert kept(nullable, {"op": "eq", "column": "score", "value": None}) == []
    assert len(kept(nullable, {"op": "not", "expr": {"op": "eq", "column": "score", "value": None}})) == 20
    assert len(kept(nullable, {"op": "ne", "column": "name", "value": "item_1"})) == 12
    assert len(kept(nullable, {"op": "not_in", "column": "id", "values": [1, None]})) == 19
    assert kept(nullable, {"op": "in", "column": "id", "values": []}) == []
    assert len(kept(nullable, {"op": "and", "exprs": []})) == 20 and kept(nullable, {"op": "or", "exprs": []}) == []
    # three-valued OR: null OR true keeps the row
    assert 3 in kept(nullable, {"op": "or", "exprs": [{"op": "gt", "column": "score", "value": 100}, {"op": "eq", "column": "id", "value": 3}]})
    assert kept(nullable, {"op": "eq", "column": "flag", "value": True}) == [2, 4, 8, 10, 14, 16]
    assert kept(nullable, {"op": "eq", "column": "id", "value": "10"}) == [10]
    assert kept(nullable, {"op": "gt", "column": "name", "value": 5}) == []  # no number in the text


def test_scalars(spark, people):
    def one(expr, df=people):
        return [r.x for r in apply(df, [op("derive", name="x", expr=expr)]).collect()]

    zero = {"kind": "bin_op", "op": "div", "left": c("val"), "right": v(0)}
    assert all(math.isnan(x) for x in one(zero))
    assert one({"kind": "length", "expr": c("name")}) == [5, 3, 7, 5]
    assert one({"kind": "substr", "expr": c("name"), "start": 0, "len": 3}) == ["ali", "bob", "cha", "ali"]
    assert one({"kind": "substr", "expr": c("name"), "start": -1, "len": 3}) == [""] * 4
    assert one({"kind": "substr", "expr": c("name"), "start": 4, "len": None}) == ["e", "", "lie", "e"]
    assert one({"kind": "concat", "parts": [c("name"), v(None)]}) == [None] * 4
    assert one({"kind": "coalesce", "exprs": [v(None), c("val")]}) == ["10", "20", "30", "40"]
    assert one({"kind": "case", "whens": [[{"op": "gt", "column": "val", "value": 25}, c("val")]]}) == [None, None, "30", "40"]
    ranked = apply(people, [op("derive", name="x", expr={"kind": "rank", "order": [{"column": "val", "descending": True}]})]).orderBy("val")
    assert [r.x for r in ranked.collect()] == [4, 3, 2, 1]
    assert sorted(one({"kind": "n_tile", "n": 3})) == [1, 1, 2, 3]
    assert one({"kind": "abs", "0": {"kind": "bin_op", "op": "sub", "left": v(1), "right": c("val")}}) == [9, 19, 29, 39]
    assert one({"kind": "cast", "expr": c("name"), "to_type": "int64"}) == [None] * 4
    nums = spark.createDataFrame([(3.567,), (-2.5,), (2.5,), (None,)], "n double").coalesce(1)
    assert one({"kind": "round", "expr": c("n"), "decimals": 2}, nums)[0] == 3.57
    assert one({"kind": "round", "expr": c("n"), "decimals": 0}, nums) == [4, -3, 3, None]
    times = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    assert one({"kind": "cast", "expr": c("t"), "to_type": "text"}, times) == ["2024-01-02T03:04:05"]
    assert one({"kind": "year", "expr": c("t")}, times) == [2024]
    assert one({"kind": "trim", "expr": v("  a b\t")}, times) == ["a b"]


def test_row_numbers_across_partitions(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "(id * 7919) % 5003 as x")
    got = apply(df, [op("derive", name="r", expr={"kind": "rank", "order": [{"column": "x", "descending": False}]})]).toPandas().sort_values("x")
    assert got.r.tolist() == list(range(1, 5001))
    tiles_ = apply(df, [op("derive", name="t", expr={"kind": "n_tile", "n": 4})]).groupBy("t").count().collect()
    assert sorted((r.t, r["count"]) for r in tiles_) == [(1, 1250), (2, 1250), (3, 1250), (4, 1250)]


def test_global_percentile(spark):
    df = spark.range(0, 30_000, 1, 3).selectExpr("cast((id * 7919) % 10007 as double) v").unionAll(spark.range(100).selectExpr("cast(null as double)"))
    values = sorted(r.v for r in df.collect() if r.v is not None)
    for p in (0, 1, 37.5, 50, 99.99, 100):
        got = apply(df, [op("group_by", keys=[], aggs=[{"fn": "percentile", "column": "v", "p": p, "alias": "x"}])]).first().x
        assert got == values[math.floor(p / 100 * (len(values) - 1) + 0.5)]


def test_operations(people):
    assert [tuple(r) for r in apply(people, [op("deduplicate", columns=["name"])]).collect()] and apply(people, [op("deduplicate", columns=["name"])]).count() == 3
    assert sorted(r.val for r in apply(people, [op("deduplicate", columns=["name", "nope"])]).collect()) == [10, 20, 30]
    got = apply(people, [op("group_by", keys=["name"], aggs=[{"fn": "sum", "column": "val", "alias": "s"}, {"fn": "percentile", "column": "val", "p": 50, "alias": "p"}])]).collect()
    assert [tuple(r) for r in got] == [("alice", 50.0, 40.0), ("bob", 20.0, 20.0), ("charlie", 30.0, 30.0)]
    assert apply(people, [op("rename", mappings=[["name", "val"], ["val", "name"]])]).columns == ["val", "name"]
    assert [r.val for r in apply(people, [op("limit", n=2)]).collect()] == [10, 20]
    assert apply(people, [op("sample", n=100, strategy="system")]).count() == 4
    with pytest.raises(KeyError):
        apply(people, [op("group_by", keys=["nope"], aggs=[])])
    with pytest.raises(KeyError):
        apply(people, [op("filter", predicate={"op": "eq", "column": "nope", "value": 1})])
    with pytest.raises(ValueError):
        View.from_json({"source_id": "s", "ops": [{"type": "join"}]})


def test_sort_nulls(spark):
    df = spark.createDataFrame([(3.0,), (None,), (1.0,), (None,)], "x double")

    def order(d, last):
        return [r.x for r in apply(df, [op("sort", keys=[{"column": "x", "descending": d, "nulls_last": last}])]).collect()]

    assert order(False, True) == [1, 3, None, None] and order(False, False) == [None, None, 1, 3]
    assert order(True, True) == [3, 1, None, None] and order(True, False) == [None, None, 3, 1]


def test_canonical_order(people):
    late = [op("limit", n=1), op("filter", predicate={"op": "gt", "column": "x", "value": 25}), op("derive", name="x", expr=c("val"))]
    assert [o["type"] for o in canonical(late)] == ["derive", "filter", "limit"]
    assert [r.val for r in apply(people, late).collect()] == [30]
    assert apply(people, [op("select", columns=["name"]), op("filter", predicate={"op": "gt", "column": "val", "value": 25})]).columns == ["name"]


def test_plans(spark):
    df = readers.read_parquet(spark, [f"{DATA}/lineitem.parquet"])
    plan = apply(df, [op("filter", predicate={"op": "gt", "column": "l_quantity", "value": 49}), op("select", columns=["l_tax"])])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "l_orderkey" not in plan.split("ReadSchema")[-1]
    plan = apply(df, [op("sort", keys=[{"column": "l_tax"}]), op("limit", n=5)])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    plan = apply(df, [op("filter", predicate={"op": "gte", "column": "l_shipdate", "value": "1996-01-01"})])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_profile(spark, nullable):
    got = {r["column"]: r for r in profile.column_stats(nullable, exact=True).collect()}
    assert got["score"]["null_count"] == 7 and got["score"]["distinct"] == 14 and abs(got["score"]["null_rate"] - 0.35) < 1e-12
    assert got["flag"]["mean"] is None and got["name"]["min"] == "item_1"
    one = spark.createDataFrame([(5.0, "a")] * 3, "x double, y string")
    assert [(r.lo, r.hi, r["count"]) for r in profile.histogram(one, "x").collect()] == [(5.0, 6.0, 3)]
    assert profile.histogram(one.filter("x < 0"), "x").count() == 0
    assert [tuple(r) for r in profile.top_values(one, "y").collect()] == [("a", 3, 1.0)]
    many = spark.range(500).selectExpr("cast(id as string) s")
    assert profile.top_values(many, "s").count() == 0
    xy = spark.range(50).selectExpr("cast(id as double) x", "2.0D * id + 1 y", "1.0D one", "case when id = 3 then double('NaN') else -id end z")
    r = {(a.x, a.y): a.r for a in profile.correlations(xy).collect()}
    assert abs(r["x", "y"] - 1) < 1e-9 and r["x", "one"] is None and r["one", "one"] == 1.0 and abs(r["x", "z"] + 1) < 1e-9
    blocks = profile.block_stats(spark.range(0, 100, 1, 1), "id", 40).orderBy("row_offset").collect()
    assert [(b.row_offset, b.row_count, b["mean"]) for b in blocks] == [(0, 40, 19.5), (40, 40, 59.5), (80, 20, 89.5)]


def test_exact_quantiles(spark):
    """By nearest rank: values that repeat, skew, signs, nulls and no numbers, in one pass and in many."""
    df = spark.range(0, 30_000, 1, 3).selectExpr(
        "id * 7919 % 30000 - 15000 a", "case when id % 3 > 0 then exp(id % 500) end b", "if(id % 10 < 6, 1.0D, double(id % 2)) c", "case when id % 7 = 0 then double('NaN') when id % 7 = 1 then double('-inf') else -0.0D end d",
        "cast(null as double) e", "cast(id as string) f", "case when id < 3 then id end g", "cast(id / 100 as decimal(12, 2)) h")
    rows, want = df.toPandas(), {}
    for n in "abcdegh":
        x = sorted(float(y) for y in rows[n].dropna() if math.isfinite(y))
        want[n] = [x[max(1, math.ceil(len(x) * p / 100)) - 1] if x else None for p in profile.POINTS]
    assert profile.exact_quantiles(df, list("abcdegh")) == want
    assert profile.exact_quantiles(df, list("abcdegh"), 2) == want
    got = {r["column"]: [r[f"p{p}"] for p in profile.POINTS] for r in profile.column_stats(df, exact=True).collect()}
    assert got == want | {"f": [None] * len(profile.POINTS)}


def test_exact_quantiles_of_many_values(spark):
    """Four million distinct values, more than a sketch of an accuracy of a million tells apart."""
    df = spark.range(0, 4_000_000, 1, 4).selectExpr("cast(id * 7919 % 4000000 as double) x")
    got = profile.column_stats(df, exact=True).first()
    assert [got[f"p{p}"] for p in profile.POINTS] == [p * 40_000 - 1.0 for p in profile.POINTS] and got["distinct"] == 4_000_000


def test_landmarks(spark):
    df = spark.range(0, 1000, 1, 1).selectExpr("case when id between 500 and 599 then null else id % 10 end a", "case when id between 500 and 599 then null else 1 end b", "case when id between 500 and 599 then null else 'x' end c", "case when id = 250 then 1e6 else id % 7 end d")
    got = {(r.type, r.row_offset) for r in profile.landmarks(df, 100).collect()}
    assert ("null_surge", 500) in got and ("outlier", 200) in got


def test_landmarks_beyond_a_view(spark, tmp_path):
    """All blocks that stand out, also over 200."""
    df = spark.range(0, 3000, 1, 1).selectExpr("case when id % 10 = 3 then 1e6 else id % 7 end d")
    assert [r.row_offset for r in profile.landmarks(df, 10).collect()] == list(range(0, 3000, 10))
    assert [r.row_offset for r in profile.landmarks(df, 10, 20).collect()] == list(range(0, 200, 10))


def test_landmarks_of_a_larger_table(spark):
    same(queries.QUERIES["landmarks"](spark, "/root/testdata/sf0.1"), connect("/root/testdata/sf0.1"), queries.ORACLES["landmarks"])


def test_tiles(spark):
    df = readers.read_parquet(spark, [f"{DATA}/orders.parquet"])
    a = tiles.source_tile(df, 10, 1, 5, 2).toPandas()
    b = df.drop(pipeline.PLACE).toPandas().iloc[10:15, 1:3].reset_index(drop=True)
    assert a.equals(b)
    assert tiles.source_tile(df, 10_000_000).count() == 0
    assert tiles.tile_rows_for_group(1000) == 1000 and tiles.tile_rows_for_group(16_000) == 1000 and tiles.tile_rows_for_group(10**6) == 8192
    assert tiles.tile_key("s", "h", 1, 2) == "tt:tile:s:h:1:2"
    assert len(tiles.tile_bytes(tiles.source_tile(df))) > 0
    assert tiles.search(df, "no such text").count() == 0


def test_sources(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
        (next(iter((tmp_path / f"p{i}").glob("part-*.parquet")))).rename(tmp_path / f"f{i}.parquet")
    engine = Engine(spark)
    s = engine.register(f"{tmp_path}/f*.parquet")
    assert [r.id for r in engine.tile(View(s.id), 8, 0, 4, 1).collect()] == [8, 9, 10, 11]
    spark.range(3).selectExpr("cast(id as string) id").coalesce(1).write.parquet(f"{tmp_path}/q")
    (next(iter((tmp_path / "q").glob("part-*.parquet")))).rename(tmp_path / "f9.parquet")
    with pytest.raises(readers.SourceError, match="schema mismatch"):
        engine.register(f"{tmp_path}/f*.parquet")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx,y\n2\tz\n")
    assert [tuple(r) for r in readers.open_source(spark, f"{tmp_path}/t.tsv", place=False)[0].collect()] == [(1, "x,y"), (2, "z")]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    t = engine.register(f"{tmp_path}/t.jsonl")
    assert engine.count(View(t.id, [op("filter", predicate={"op": "gt", "column": "a", "value": 1})])) == 1
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "changed"}\n')
    with pytest.raises(readers.SourceError, match="source_modified"):
        engine.get(t.id)
    with pytest.raises(readers.SourceError):
        readers.delta_files(f"delta://{tmp_path}/none")
    with pytest.raises(readers.SourceError):
        engine.register("hf://datasets/a/b")
    df = spark.createDataFrame([(1, None, float("inf"))], "a int, b string, x double")
    assert [r.value for r in sinks.json_lines(df).collect()] == ['{"a":1,"b":null,"x":null}']
    with pytest.raises(ValueError):
        sinks.write(df, f"{tmp_path}/x", "xlsx")


def test_exported_code_runs(spark):
    ops = [op("derive", name="k", expr={"kind": "case", "whens": [[{"op": "lt", "column": "c_acctbal", "value": 0}, v("debt")]], "else_expr": {"kind": "upper", "expr": c("c_mktsegment")}}), op("deduplicate", columns=["c_nationkey", "k"]), op("group_by", keys=["k"], aggs=[{"fn": "count", "alias": "n"}, {"fn": "median", "column": "c_acctbal", "alias": "m"}]), op("sort", keys=[{"column": "n", "descending": True}])]
    path = f"{DATA}/customer.parquet"
    want = [(r.k, r.n, round(r.m, 6)) for r in apply(readers.read_parquet(spark, [path]), ops).collect()]
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    for target in ("python_duckdb", "pandas"):
        space: dict = {}
        exec(export.code(ops, path, columns, target), space)
        assert [(a, b, round(m, 6)) for a, b, m in space["result"].itertuples(index=False)] == want
    assert [(a, b, round(m, 6)) for a, b, m in duckdb.connect().execute(export.code(ops, path, columns, "duckdb_sql")).fetchall()] == want


def test_predicate_editing():
    ops = predicates.add_predicate([], {"op": "eq", "column": "a", "value": 1})
    ops = predicates.add_predicate(ops, {"op": "gt", "column": "b", "value": 2})
    assert ops[0]["predicate"]["op"] == "and" and len(predicates.active_predicates(ops)) == 2
    assert predicates.remove_predicate(ops, "a")[0]["predicate"] == {"op": "gt", "column": "b", "value": 2}
    assert predicates.remove_predicate(predicates.remove_predicate(ops, "a"), "b") == []
    assert predicates.exclude_value(predicates.exclude_value([], "c", 1), "c", 2)[0]["predicate"]["values"] == [1, 2]


def test_stream_refuses(spark):
    df = spark.readStream.schema("a int").parquet("/tmp")
    with pytest.raises(ValueError):
        apply_stream(df, [op("limit", n=1)])
    assert apply_stream(df, [op("rename", mappings=[["a", "b"]])]).columns == ["b"]
    assert F is not None


def test_command_line(spark, tmp_path, capsys):
    from gridloom.__main__ import main

    path = f"{DATA}/orders.parquet"
    assert main(["inspect", path]) == 0 and '"rows": 1500' in capsys.readouterr().out
    where = '{"op": "eq", "column": "o_orderstatus", "value": "F"}'
    assert main(["export", path, "--format", "parquet", "-o", f"{tmp_path}/o", "--filter", where, "--columns", "o_orderkey", "--limit", "7"]) == 0
    assert spark.read.parquet(f"{tmp_path}/o").count() == 7
    assert main(["codegen", path, "--target", "duckdb_sql", "--filter", where]) == 0
    assert duckdb.connect().execute(capsys.readouterr().out).fetchall()
    (tmp_path / "v.json").write_text('{"source_id": "%s", "ops": [{"type": "limit", "n": 3}]}' % path)
    assert main(["apply", f"{tmp_path}/v.json", "--format", "csv", "-o", f"{tmp_path}/c"]) == 0
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 3
    assert main(["profile", f"{DATA}/region.parquet"]) == 0 and len(capsys.readouterr().out.splitlines()) == 2


def test_places_over_files(spark, tmp_path):
    """Row numbers over many files, by path or URI, beyond the map of starts, too; filters reach the scan."""
    from gridloom.sources import readers

    spark.range(5000).repartitionByRange(4, "id").sortWithinPartitions("id").withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    for most in (1000, 2):
        old, readers.MAX_NUMBERED = readers.MAX_NUMBERED, most
        try:
            for uri in (str(tmp_path / "t"), f"file://{tmp_path}/t"):
                df = readers.read_parquet(spark, [uri])
                assert df.filter(F.col("id") != F.col(PLACE)).count() == 0 and df.count() == 5000
            if most == 1000:
                plan = df.filter("x > 9000")._jdf.queryExecution().executedPlan().toString()
                assert "GreaterThan(x,9000)" in plan
        finally:
            readers.MAX_NUMBERED = old
    spark.read.parquet(str(tmp_path / "t")).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("header", True).csv(str(tmp_path / "c"))
    df = readers.numbered(readers.read_csv(spark, str(tmp_path / "c")))
    assert df.filter(F.col("id") != F.col(PLACE)).count() == 0
    engine = Engine(spark)
    s = engine.register(f"file://{tmp_path}/t", "t")
    assert [r.id for r in engine.tile(View(s.id), 2500).collect()] == list(range(2500, 2756)) and engine.count(View(s.id)) == 5000
    up = engine.upload(spark.range(300).toPandas(), "u")
    assert [r.id for r in engine.tile(View(up.id), 250).collect()] == list(range(250, 300))
