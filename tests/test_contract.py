import __spark_entry__ as entry
import pytest

SMOKE = "/root/testdata/sf0.001"


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 40


def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "doc", "score", "rank"]


@pytest.mark.parametrize("name", ["mrr_at_k", "span_theta_join", "loss_infonce", "sample_batches", "comment_to_query_skip", "file_gate_status"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{SMOKE}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SMOKE)
    cols = sorted(df.columns)
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]

    def key(v):
        return round(v, 9) if isinstance(v, float) else v

    want = sorted(str(tuple(key(row[names.index(x)]) for x in cols)) for row in r.fetchall())
    assert sorted(str(tuple(key(row[x]) for x in cols)) for row in df.collect()) == want
