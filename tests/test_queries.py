"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace import bindings

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(plain(x) for x in v)
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return v.item() if hasattr(v, "item") else v

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(bindings.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = bindings.QUERIES[name](spark, sf_dir).toPandas()
    if name not in bindings.ORACLES:
        assert len(got)
        return
    want = duck.execute(bindings.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
