"""Comparison of a Spark result with DuckDB's, whatever the order of rows and columns."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        x = round(x, 6)
        return int(x) if x == int(x) else x
    return int(x) if isinstance(x, bool) else str(x) if not isinstance(x, (int, str)) else x


def rows(pdf):
    names = sorted(pdf.columns)
    return sorted(repr(tuple(value(x) for x in r)) for r in pdf[names].astype(object).itertuples(index=False, name=None))


def connect(top=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{top}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(df, con, sql):
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
