"""Every query with SQL gives the rows of its SQL; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from blockloom.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return c


def shown(df):
    cols = sorted(df.columns)
    same = lambda x: None if x is None or x != x else x if isinstance(x, (str, bool)) else float(x)
    return sorted(tuple(repr(same(x)) for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
