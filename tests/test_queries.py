"""Every registered query runs on the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import queries as reference

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the public tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [str(x) for x in r])


@needs_data
@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_reference_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    assert got
    if name in entry.oracle_sql():
        want = oracle.execute(entry.oracle_sql()[name]).df()
        assert sorted(want.columns) == cols
        assert plain(got) == plain(want[cols].astype(object).itertuples(index=False, name=None))


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
