"""Corpus queries against their SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import glob
import os

import pytest

from ticklake.llm import oracles, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = connection.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in places) for r in found.fetchall()), key=repr)


def test_sql_of_nulls_and_ties(spark, tmp_path):
    docs = [(1, "A b a B a b", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "S", 0), (None, "A b", None, "s", 3), (2, "A b", "en", "ä", 3), (2, "A b", "en", "ä", 3)]
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>É</p>"), (4, "v", "<p>É</p>")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    for name, sql in (("op11_collocations", oracles.OP11_SQL), ("op12_merkle_manifest", oracles.OP12_SQL), ("op13_warc", oracles.OP13_SQL)):
        df = queries.QUERIES[name](spark, str(tmp_path))
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr), name
