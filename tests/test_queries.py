"""Every registered query against its SQL counterpart, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame):
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(float(x)) if isinstance(x, float) or "float" in type(x).__name__ else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"score_frozen", "thinning_probe"}))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_oracle_names_are_registered():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["fold", "n", "accuracy", "macro_f1"]
