"""Registered queries against their SQL in DuckDB, over the driver's smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from hyperweft.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    value = lambda x: None if pd.isna(x) else float(x) if not isinstance(x, (str, bool)) else x
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted({"mannwhitney_p", "dual_orc_curvature", "greedy_attach", "h_louvain", "orchid_curvature"}))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
