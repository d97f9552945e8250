import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import packing


def _check(spark, sizes, capacities):
    items = spark.createDataFrame([(i, int(s), "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    targets = spark.createDataFrame([(i, c) for i, c in enumerate(capacities)], "target_id long, capacity_tokens long")
    p = packing.pack(items, targets).cache()
    for i, c in enumerate(capacities):
        rows = p.filter(F.col("target_id") == i).collect()
        by_item, by_container = {}, {}
        for r in rows:
            by_item.setdefault(r.doc_id, []).append((r.start, r["size"], r.piece))
            by_container[r.container] = by_container.get(r.container, 0) + r["size"]
        assert all(v <= c for v in by_container.values())
        assert set(by_item) == {j for j, s in enumerate(sizes) if s > 0}
        for j, pieces in by_item.items():  # the pieces are the item, in order, and only long ones are divided
            pieces.sort()
            assert [x[0] for x in pieces] == [sum(y[1] for y in pieces[:k]) for k in range(len(pieces))] and sum(x[1] for x in pieces) == sizes[j]
            assert [x[2] for x in pieces] == list(range(len(pieces))) and (len(pieces) == 1 or sizes[j] > c)
    return {r.target_id: r.fill for r in packing.fill_rates(p, targets).collect()}


def test_round_trip(spark):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(0, 1200, 1500), rng.geometric(0.01, 1500)]).tolist()
    fill = _check(spark, sizes, [64, 512, 2048, 4096])
    assert min(fill.values()) > 0.96


def test_hot_length(spark):
    """A third of all items have one length that doesn't divide the capacity."""
    rng = np.random.default_rng(2)
    sizes = np.array([300] * 1000 + rng.integers(1, 500, 2000).tolist())
    fill = _check(spark, sizes.tolist(), [512, 1000])
    alone = (sizes > 256).sum()  # no two of these fit together
    assert fill[0] > 0.98 * sizes.sum() / (512 * alone) and fill[1] > 0.97


def test_edges(spark):
    assert _check(spark, [10, 10, 20, 21, 0], [10]) == {0: pytest.approx(61 / 70)}
    assert _check(spark, [7, 7, 7], [10]) == {0: pytest.approx(0.7)}
    items = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (2, None), (3, -1), (4, 0)], "doc_id long, n_tokens long")
    targets = spark.createDataFrame([(1, 10), (1, 10), (2, None), (3, 0)], "target_id long, capacity_tokens long")
    assert [(r.target_id, r.doc_id, r["size"]) for r in packing.pack(items, targets).collect()] == [(1, 1, 5), (1, 1, 5)]
    assert packing.pack(items.limit(0), targets).count() == 0 and packing.pack(items, targets.limit(0)).count() == 0


def test_least_squares():
    counts = np.zeros(65, int)
    counts[[20, 44, 16, 8]] = [100, 100, 50, 100]
    rows, repeats = packing.plan(64, counts, 1)
    used = sum(n * np.bincount(r, minlength=65) for r, n in zip(rows, repeats))
    assert (used[1:] <= counts[1:]).all() and used[20] >= 95 and used[44] >= 60
    assert all(62 <= r.sum() <= 64 for r in rows) and (repeats > 0).all()
    sizes = np.array([5, 5, 3, 2, 8])
    where = packing.best_fit(sizes, 10)
    assert max(np.bincount(where, weights=sizes)) <= 10 and len(set(where)) == 3


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "x " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got[1] == 3 and got[2] == 0 and 3 not in got and got[4] >= 100_000
