"""Every query with SQL gives what DuckDB gives; the others run and have rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomspan import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]) or not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda x: x if x is None else str(x)[:10] if hasattr(x, "year") else str(x))
        else:
            df[c] = df[c].astype(float)
    exact = [c for c in df.columns if df[c].dtype == object]
    return df.sort_values(exact + [c for c in df.columns if c not in exact]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = tidy(catalog.QUERIES[name](spark, SF).toPandas()), tidy(duck.execute(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object:
            assert got[c].tolist() == want[c].tolist(), c
        else:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-6, atol=2e-6, err_msg=c)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
