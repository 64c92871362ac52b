"""The operators that SQL can express, against it on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from corpusmill.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    sql = oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == columns
    rows = sorted(map(tuple, df.select(*columns).collect()))
    assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()) and rows
