"""Every query with SQL agrees with DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(oracle_sql())
ROWS_ONLY = sorted(set(queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    out = [tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda t: [(x is None, str(type(x)), 0 if x is None else x) for x in t])


def test_names_match():
    assert set(WITH_SQL) <= set(queries())


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, duck, name):
    want = duck.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["station_id", "penury_rate", "saturation_rate"]
