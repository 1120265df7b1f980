"""Operators and parts of operators that SQL can express, against DuckDB on the driver's tables."""

import duckdb
import pytest

from barloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    keys = list(want.columns[:2])
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in want.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all() or (got[c] - want[c]).abs().max() < 2e-4, c
