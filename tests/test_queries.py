"""Every query with SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from strata.plans import REGISTRIES

SF = "/root/testdata/sf0.001"
QUERIES = {n: f for r in REGISTRIES for n, f in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    picked = want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert got == sorted((tuple(map(value, r)) for r in picked), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
