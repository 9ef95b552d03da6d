"""Every registered query of the engine equals its DuckDB SQL on the smallest tables."""

import pytest

from gridloom import queries

from .helpers import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.ORACLES:
        same(df, con, queries.ORACLES[name])
    else:
        df.collect()
