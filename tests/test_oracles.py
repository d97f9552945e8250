"""Every query that has SQL gives the rows of its SQL."""

import glob
import os

import __spark_entry__ as entry
import pytest

DATA = "/root/testdata/sf0.01"  # at sf0.001 no query id is divisible by 100


@pytest.fixture(scope="module")
def database():
    c = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _key(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows(spark, database, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = database.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(x) for x in cols]
    want = sorted(str(tuple(_key(row[i]) for i in at)) for row in r.fetchall())
    assert sorted(str(tuple(_key(row[x]) for x in cols)) for row in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
