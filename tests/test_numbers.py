import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.functions import arrays as A
from codequarry.operators import dense, evaluate, losses, sampling, tfidf, training


def test_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 9],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(A.truncate(F.col("ids"), 4, 9)).collect()] == [[1, 2, 3, 9], [1, 9], [9]]
    assert df.select(A.truncate(F.col("ids"), 4, 9, False)).first()[0] == [1, 2, 3, 4, 9]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 9]), (0, [3, 9]), (1, [])], "b int, ids array<int>")
    got = sorted((r.b, r.ids, r["mask"]) for r in training.padded_batches(df, ["b"]).collect())
    assert got == [(0, [1, 2, 9], [1, 1, 1]), (0, [3, 9, 0], [1, 1, 0]), (1, [], [])]


def test_learning_rate(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 2, 6, 10, 12)], "s int").select(A.learning_rate(F.col("s"), 2, 10))
    assert [r[0] for r in df.collect()] == [0, 0.5, 1, 0.5, 0, 0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(A.normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0, 0]]
    assert df.select(A.first_dimensions(F.col("v"), 1)).first()[0] == [1.0]
    states = spark.createDataFrame([([[1.0], [2.0], [3.0]], 2)], "s array<array<double>>, m int")
    assert states.select(A.pool_eos(F.col("s"), F.col("m"))).first()[0] == [2.0]


def _ce(m):
    t = m.max(1)
    return t + np.log(np.exp(m - t[:, None]).sum(1)) - np.diag(m[:, : len(m)])


@pytest.fixture(scope="module")
def batch(spark):
    rng = np.random.default_rng(1)
    q, p, n = (rng.standard_normal((6, 8)) for _ in range(3))
    q, p, n = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, p, n))
    pairs = spark.createDataFrame([(0, i, q[i].tolist(), p[i].tolist()) for i in range(6)], "batch int, i int, q array<double>, p array<double>")
    negatives = spark.createDataFrame([(0, i, n[i].tolist()) for i in range(6)], "batch int, i int, n array<double>")
    return q, p, n, pairs, negatives


def test_losses(batch):
    q, p, n, pairs, negatives = batch
    t, big = 0.05, 10000 * np.eye(6)
    qp, qq, pp, qn = q @ p.T, q @ q.T - big, p @ p.T - big, q @ n.T
    rows, columns = _ce(qp / t).mean(), _ce(qp.T / t).mean()
    with_n = _ce(np.hstack([qp, qn]) / t).mean()
    assert losses.infonce(pairs).first().loss == pytest.approx(rows, abs=1e-9)
    assert losses.clip(pairs).first().loss == pytest.approx((rows + columns) / 2, abs=1e-9)
    assert losses.clip(pairs, negatives, reduce_dirs="sum").first().loss == pytest.approx(with_n + columns, abs=1e-9)
    g, gc = _ce(np.hstack([qp, qq]) / t).mean(), _ce(np.hstack([qp.T, pp]) / t).mean()
    assert losses.gte(pairs).first().loss == pytest.approx((g + gc) / 2, abs=1e-9)
    assert losses.gte(pairs, negatives, reduce_dirs="sum").first().loss == pytest.approx(_ce(np.hstack([qp, qq, qn]) / t).mean() + gc, abs=1e-9)
    own = np.diag(qp)[:, None] + 0.1
    m = [np.where((x > own) & ~np.eye(6, dtype=bool), -10000, x) for x in (qp, qq, pp)]
    got = losses.false_negative_masked(pairs).first()
    assert got.loss == pytest.approx(_ce(np.hstack(m) / t).mean(), abs=1e-9) and got.n_masked == sum(int((x == -10000).sum()) for x in m)


def test_kl(spark):
    rows = [(0, q, float(j), float(j) * 2) for q in range(2) for j in range(3)]
    df = spark.createDataFrame(rows, "batch int, query int, student double, teacher double")
    assert losses.kl(df, 1.0, 2.0).first().loss == pytest.approx(0, abs=1e-12)
    s, t = np.arange(3.0), 2 * np.arange(3.0)
    ls, lt = s - np.log(np.exp(s).sum()), t - np.log(np.exp(t).sum())
    assert losses.kl(df).first().loss == pytest.approx((np.exp(lt) * (lt - ls)).sum(), abs=1e-12)


def test_mrr(spark):
    df = spark.createDataFrame([("a", [(0.1, True), (0.9, False), (0.5, True)]), ("a", [(1.0, False)]), ("a", None)], "v string, ranked array<struct<score:double,hit:boolean>>")
    r = evaluate.mrr(df, ["v"]).first()
    assert r.n == 3 and r.score == pytest.approx(0.5 / 3)


def test_topk_and_padding(spark):
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(([1.0, 0.0], [0.0, 1.0], [1.0, 0.0], None))], "d int, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "q int, v array<double>")
    got = [(r.doc, r["rank"]) for r in dense.dense_top_k(q, docs, 10, "q", "v", "d", "v").orderBy("rank").collect()]
    assert got == [(0, 1), (2, 2), (1, 3)]
    top = spark.createDataFrame([(7, 1, 1, 0.5), (7, 2, 2, 0.2)], "query int, rank long, doc int, score double")
    p = tfidf.padded(top, spark.createDataFrame([(7,)], "query_id int"), 3, spark.createDataFrame([(9,)], "doc int"))
    assert [(r.doc, r.score) for r in p.orderBy("rank").collect()] == [(1, 0.5), (2, 0.2), (9, -100.0)]


def test_dense_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 5))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "d int, v array<double>").repartition(5)
    q = docs.filter("d % 10 = 0")
    got = {(r.query, r["rank"]): r.doc for r in dense.dense_top_k(q, docs, 4, "d", "v", "d", "v", block_bytes=100).collect()}
    for i in range(0, 200, 10):
        s = np.round(x @ x[i], 6)
        assert [got[i, k] for k in range(1, 5)] == np.lexsort((np.arange(200), -s))[:4].tolist()


def test_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = sampling.batches(df, "k", 32, 1, drop_last=True).collect()
    assert len(rows) == 992 and len({r.k for r in rows}) == 992 and {(r.batch_id, r.place) for r in rows} == {(b, p) for b in range(31) for p in range(32)}
    assert sampling.batches(df.limit(0), "k", 32).count() == 0


def test_training_batches(spark):
    rows = [(i, [1, 2, 3], [([4] * (i + 1),)], [([5, 6],)]) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, question array<int>, positives array<struct<context:array<int>>>, negatives array<struct<context:array<int>>>")
    got = training.contrastive_batches(df, "k", 2, 4, 9).collect()
    assert len(got) == 12 and all(len(r.ids) == len(r["mask"]) <= 4 for r in got)
    kd = spark.createDataFrame([(0, [1], [([2], 0.5), ([3], 0.1)])], "k int, question array<int>, candidates array<struct<context:array<int>,score:double>>")
    assert training.distillation_batches(kd, "k", 1, 2, 4, 9).count() == 3
    with pytest.raises(Exception, match="too few"):
        training.distillation_batches(kd, "k", 1, 3, 4, 9).collect()


def test_describe_and_report(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 102)], "x double")
    r = evaluate.describe(df, "x").first()
    assert (r.stat_min, r.stat_max, r.p50, r.p25, r.p99) == (1, 101, 51, 26, 100)
    s = spark.createDataFrame([("v", "a", 1.0), ("v", "b", 0.0), ("w", "a", math.nan)], "version string, bench string, score double")
    assert {x.version: x.score for x in evaluate.mean_of_means(s, ["version"], ["bench"]).collect()} == {"v": 0.5}
    assert evaluate.pivot(s.filter("version = 'v'"), "version", "bench", ["a", "b"]).first().asDict() == {"version": "v", "a": 1.0, "b": 0.0, "AVG": 0.5}
