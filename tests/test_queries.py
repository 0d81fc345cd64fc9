"""Every query with SQL equals it on the smallest data, as the driver compares them; the streams equal their batch forms by the same SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("LAVRA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    show = lambda v: "" if v is None or pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    df = df[sorted(df.columns)]
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, db, name):
    ours, sql = entry.queries()[name](spark, FOLDER).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
