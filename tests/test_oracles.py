"""Every query with oracle SQL gives DuckDB's rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from barloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    exact = [c for c in frame.columns if not pd.api.types.is_float_dtype(frame[c])]
    return frame.sort_values(exact + [c for c in frame.columns if c not in exact], kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = ordered(got), ordered(want[got.columns])
    assert len(got) == len(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if pd.api.types.is_numeric_dtype(a) and not pd.api.types.is_bool_dtype(a):
            assert np.allclose(a.astype(float), b.astype(float), rtol=1e-6, atol=2e-5, equal_nan=True), c
        else:
            assert (a.astype(str) == b.astype(str)).all(), c


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 100 and {"SMA_20", "Vol_20", "RegSlope_20", "trend"} <= set(rows.columns)


def test_registered_names_match():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
