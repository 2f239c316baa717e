"""Every registered query with SQL equals DuckDB's answer over the same tables; the others run and return rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewave import queries as q


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = df.map(lambda x: None if x is None or (isinstance(x, float) and np.isnan(x)) else x)
    return sorted(map(tuple, plain.astype(str).values))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, duck, name):
    got = q.QUERIES[name](spark, sf).toPandas()
    if name not in q.SQL:
        assert len(got)
        return
    want = duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["event_id", "y"] and df.count() == 1000
    assert set(q.QUERIES) <= set(e.queries()) and set(q.SQL) <= set(e.oracle_sql())
