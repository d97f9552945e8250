"""Queries whose SQL in ORACLES covers only a part of their rows: here against SQL over all of them."""

import glob
import os

import __spark_entry__ as entry
import pytest

from codequarry.plans import registry

DATA = "/root/testdata/sf0.01"  # at sf0.001 no query id is divisible by 100


def _key(v):
    return round(v, 9) if isinstance(v, float) else v


def _same(spark, name, sql):
    """The query's rows are those of the SQL; gives them."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, DATA)
    cols, got = sorted(df.columns), df.collect()
    r = c.execute(sql)
    at = [[x[0] for x in r.description].index(x) for x in cols]
    want = sorted(str(tuple(_key(row[i]) for i in at)) for row in r.fetchall())
    assert sorted(str(tuple(_key(row[x]) for x in cols)) for row in got) == want
    return got


def _wider(name, *changes):
    """The query's SQL with its cut taken out; SQL that has no cut stays."""
    sql = entry.oracle_sql()[name]
    for old, new in changes:
        sql = sql.replace(old, new)
    return sql


def test_padded(spark):
    got = _same(spark, "tfidf_topk_padded", _wider("tfidf_topk_padded", ("range(100, 1001, 100)", "range(1, 1001)")))
    ranks = {}
    for r in got:
        ranks.setdefault(r["query"], []).append(r["rank"])
    assert ranks and all(sorted(x) == list(range(1, 1001)) for x in ranks.values())


def test_annotate_back(spark):
    got = _same(spark, "annotate_back", _wider("annotate_back", ("rank <= 5", "rank <= 10")))
    assert max(r["rank"] for r in got if r.answer) == 10


def test_prompt_assembly(spark):
    cuts = ("x <> ''), 1, 4)", "x <> ''), 1, 64)"), ("x <> ''), 1, 12)", "x <> ''), 1, 2048)"), ("list_slice(candidates, 1, 3)", "list_slice(candidates, 1, 10)")
    _same(spark, "prompt_assembly", _wider("prompt_assembly", *cuts))


def test_pool_without_replacement(spark):
    got = _same(spark, "csn_candidates_wor", _wider("csn_candidates_wor", ("r <= 99)", "r <= 999)"), ("r <= 99 ", "r <= 999 ")))
    assert len(got) > 99 * len({r["query"] for r in got})
    assert "WindowGroupLimit" in entry.queries()["csn_candidates_wor"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_pool_with_replacement(spark):
    gold = "UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE vec_id % 100 = 0)"
    changes = ("range(1, 100)", "range(1, 1000)"), ("% 100 = 0), n)", f"% 100 = 0), n {gold}"), ("WHEN query = e.vec_id THEN", "WHEN query = e.vec_id AND draw > 0 THEN")
    got = _same(spark, "csn_candidates_wr", _wider("csn_candidates_wr", *changes))
    assert {r["query"] for r in got} == {r["doc"] for r in got if r["draw"] == 0} and len(got) == 1000 * len({r["query"] for r in got})


@pytest.mark.parametrize("name", ["hashed-words", "tf-idf--default-analyzer"])
def test_pool_restricts(spark, name):
    q = spark.createDataFrame([(1, "sort the list", "x"), (2, "open a file", "x")], "query int, question string, lang string")
    c = spark.createDataFrame([(1, "sort the list", "x"), (2, "open a file", "x"), (3, "the list of a file", "x"), (4, "open", "y")], "id int, text string, lang string")
    pool = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 2), (2, 4)], "query int, doc int")
    run = registry.compose(name)
    for scope, allowed in ((None, {(1, 2), (1, 3), (2, 2), (2, 4)}), ("lang", {(1, 2), (1, 3), (2, 2)})):
        every = {(r["query"], r.doc): r.score for r in registry.predict(run, q, c, scope).collect()}
        got = registry.predict(run, q, c, scope, pool).collect()
        assert {(r["query"], r.doc): r.score for r in got} == {k: v for k, v in every.items() if k in allowed} and got
        assert {r["query"] for r in got if r["rank"] == 1} == {1, 2}
