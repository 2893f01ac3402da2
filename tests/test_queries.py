"""Every registered query of the listings engine on the smallest tables, against its SQL on DuckDB."""

import datetime

import duckdb
import pandas as pd
import pytest

from fernspark.plans import registry
from fernspark.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return ""
    return x.isoformat() if isinstance(x, (datetime.datetime, pd.Timestamp)) else x.item() if hasattr(x, "item") else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
