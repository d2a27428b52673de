"""Registered queries against their SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

from ticklake.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES)


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    v = float(v)
    return None if math.isnan(v) else float(f"{v:.9g}")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, connection, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = connection.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[k]) for k in places) for r in found.fetchall()), key=repr)


def test_entry_registers_every_query():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
