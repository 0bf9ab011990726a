"""Every registered query of the training-data operators runs on the smallest tables, and gives its SQL twin's rows where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from corvane.llm import queries

from ..test_registry import normal

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLE_SQL:
        pd.testing.assert_frame_equal(normal(got), normal(db.sql(queries.ORACLE_SQL[name]).df()))
    else:
        assert len(got)
