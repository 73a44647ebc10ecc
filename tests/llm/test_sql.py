"""Registered queries against their DuckDB SQL, and vectors of both widths against one another."""

import duckdb
import pytest

from millrace.llm import oracles, queries, vectors


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    result = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(result.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, result.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_vectors_of_doubles(spark, sf_dir):
    """The same links whether vectors come as floats or as doubles, and whether they come twice."""
    table = queries.table(spark, sf_dir, "embeddings")
    once = vectors.near_vectors(table).collect()
    wide = vectors.near_vectors(table.withColumn("embedding", table["embedding"].cast("array<double>"))).collect()
    assert sorted(once) == sorted(wide)
