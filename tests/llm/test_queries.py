import pytest

from codequarry.llm.queries import ORACLES, QUERIES

SMOKE = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("file_id", "bigint"), ("nl_lang", "string")], "p2_found": [("prediction_id", "bigint"), ("cand_rank", "int")], "p3_found": [("vec_a", "bigint"), ("vec_b", "bigint")], "p4_found": [("file_id", "bigint")],
    "p5_found": [("file_id", "bigint"), ("name_row", "int")], "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p8_found": [("doc_id", "bigint"), ("reading_level", "string")],
}


def test_names():
    assert set(ORACLES) <= set(QUERIES) and set(COLUMNS) <= set(QUERIES) and {n.split("_")[0] for n in QUERIES} == {f"p{i}" for i in range(1, 9)}


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, name):
    df = QUERIES[name](spark, SMOKE)
    rows = df.collect()
    assert len(rows) > 0 or name in ("p7_found", "p7_leaked_items")
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name] and len(set(rows)) == len(rows)
