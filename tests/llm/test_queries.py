"""The registered queries of the package on the smallest tables."""

import os

import duckdb
import pytest

from quarrystone.llm.queries import QUERIES
from quarrystone.llm.sql import SQL

COLUMNS = {"p1_found": ["chunk_id", "line_no"], "p2_found": ["chunk_id"], "p4_found": ["path"], "p5_found": ["path"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    found = [tuple(r) for r in df.select(*[c for c in df.columns if c not in ("redacted", "piece")]).collect()]
    assert found
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(found) == len(set(found))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")
    assert sorted(map(tuple, QUERIES[name](spark, data).collect())) == sorted(c.sql(SQL[name]).fetchall())
