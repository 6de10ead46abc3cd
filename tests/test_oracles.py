"""Every query with SQL gives the same rows as DuckDB, on whole tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest
from tallyforge.plans import catalog

DATA = "/root/testdata/sf0.001"
WANT = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows and df.columns
        return
    want = db.sql(sql)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert normal(rows, df.columns) == normal(want.fetchall(), want.columns)
    assert {c: WANT.get(t, t) for c, t in df.dtypes} == {c: types[c] for c in df.columns}
