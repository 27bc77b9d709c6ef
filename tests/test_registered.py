"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarrystone.plans.registered import QUERIES
from quarrystone.plans.sql import SQL


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    c.sql("set max_expression_depth to 2000")
    for f in os.listdir(data):
        c.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("~" if v is None or v != v else str(round(float(v), 4)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    ours = QUERIES[name](spark, data).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
