"""The registered queries against their own SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillon.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the public tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = [tuple(r[names.index(x)] for x in cols) for r in want.fetchall()]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got and sorted(got, key=str) == sorted(rows, key=str)


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.queries()) for n in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(queries.queries())
