"""Every registered query that has SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from rillframe import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "uint")):
        return round(float(v), 8)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_reason():
    without = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert without == {"q_fill_minimax", "q_kernel_delineate", "q_kernel_products"}


def test_scans_prune_columns_and_push_filters(spark):
    text = catalogue.queries()["q_inner_reference"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,0.0)" in text and "s_name" not in text
