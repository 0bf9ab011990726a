"""Every registered query gives its SQL twin's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corvane.plans import catalog

DATA = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(float).round(5) + 0.0
    out = df.astype(object).where(df.notna(), None).map(lambda v: str(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns)
        return
    pd.testing.assert_frame_equal(normal(got), normal(db.sql(catalog.ORACLES[name]).df()))
