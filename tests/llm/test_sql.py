"""Each registered query of the training-corpus operators that has SQL, against it."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sonarlake.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame):
    plain = lambda v: None if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)) else int(v) if pd.api.types.is_number(v) and float(v).is_integer() else v
    return sorted(str([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
