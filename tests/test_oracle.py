"""Every registered query of the reference's operators against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from quillspark import oracle, oracle_documents, queries_documents
from quillspark.queries import QUERIES as OWN

QUERIES, SQL = OWN | queries_documents.QUERIES, oracle.SQL | oracle_documents.SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(None if r[k] is None else f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
