import numpy as np
import pytest

from codequarry.llm import neighbours as nn


def _true(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        s = x @ x[i]
        s[i] = -9
        out[ids[i]] = [ids[j] for j in np.lexsort((ids, -s))[:k]]
    return out


def _frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "x") for i, row in zip(ids, x)], "vec_id long, v array<float>, id string")


@pytest.mark.parametrize("clusters,spread", [(1, 1.0), (40, 0.3)])
def test_recall(spark, clusters, spread):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((clusters, 16))
    x = (centres[rng.integers(clusters, size=3000)] + spread * rng.standard_normal((3000, 16))).astype(np.float32)
    ids = rng.permutation(10_000)[:3000]
    v = nn.usable(_frame(spark, ids, x), "vec_id", "v", 16)
    index = nn.build(v)
    want = _true(ids, x.astype(float), 5)
    got = {r.id: [n.id for n in r.nbrs[:5]] for r in index.graph.collect()}
    recall = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in ids])
    assert recall >= 0.9
    pairs = {(r.vec_a, r.vec_b) for r in nn.neighbour_pairs(index.graph).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, bs in got.items() for b in bs}
    some = v.filter("id % 100 = 0")
    hits = [r.id in want[r["query"]] for r in nn.search(index, v, some).collect()]
    assert np.mean(hits) >= 0.9 and len(hits) == 5 * some.count()


def test_cells_that_split(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.standard_normal(8) * 0.01 + np.eye(8)[0] + 0.05 * rng.standard_normal((4000, 8)), rng.standard_normal((400, 8))]).astype(np.float32)
    v = nn.usable(_frame(spark, range(4400), x), "vec_id", "v", 8)
    got = {r.id: {n.id for n in r.nbrs[:5]} for r in nn.neighbour_graph(v).collect()}
    want = _true(np.arange(4400), x.astype(float), 5)
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in range(4400)]) >= 0.9


def test_copies(spark):
    """A third of all rows are the same vector: all of them get the least ids of the class, and no task gets the class whole."""
    rng = np.random.default_rng(3)
    x = np.vstack([np.tile(np.eye(8)[0], (500, 1)), rng.standard_normal((1000, 8))]).astype(np.float32)
    ids = np.arange(1500)
    got = {r.id: [n.id for n in r.nbrs[:5]] for r in nn.neighbour_graph(nn.usable(_frame(spark, ids, x), "vec_id", "v", 8)).collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and all(got[i] == [0, 1, 2, 3, 4] for i in range(6, 500)) and len(got) == 1500


def test_unusable(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [2.0, 0.5]), (8, [2.0, 0.5]), (9, [-1.0, 0.0])], "vec_id long, v array<float>")
    v = nn.usable(df, "vec_id", "v", 2)
    assert sorted(r.id for r in v.collect()) == [1, 8, 8, 9]
    assert {r.id: [n.id for n in r.nbrs] for r in nn.neighbour_graph(v).collect()} == {1: [8, 9], 8: [1, 9], 9: [8, 1]}
    empty = nn.build(v.limit(0))
    assert empty.graph.count() == 0 and nn.neighbour_pairs(empty.graph).count() == 0 and nn.search(empty, v, v).count() == 0
    one = nn.build(v.filter("id = 1"))
    assert one.graph.count() == 1 and nn.neighbour_pairs(one.graph).count() == 0
