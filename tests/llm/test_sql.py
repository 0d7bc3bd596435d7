"""The queries that have SQL give DuckDB's rows, over whole tables."""

import glob
import os

import duckdb
import pytest

from strata.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(rows, key=repr)
