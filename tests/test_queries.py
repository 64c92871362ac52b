"""Every registered reference query against its SQL on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from corpusmill import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    sql = catalog.oracles()[name]
    assert sorted(duck.sql(sql).columns) == columns
    expected = sorted(tuple(map(cell, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert rows == expected


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())
