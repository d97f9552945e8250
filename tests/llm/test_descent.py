import numpy as np

from codequarry.llm import neighbours as nn


def test_rounds(spark):
    """The hashed start alone is clearly worse than what the joins make of it."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    v = nn.usable(spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "k long, v array<float>"), "k", "v", 16)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    want = np.argsort(-sims, axis=1)[:, :5]

    def recall(index):
        got = {r.id: {n.id for n in r.nbrs[:5]} for r in index.graph.collect()}
        return np.mean([len(got[i] & set(want[i].tolist())) / 5 for i in range(3000)])

    start, end = nn.build(v, rounds=0), nn.build(v)
    assert start.rounds == () and end.rounds[-1] < 30 and list(end.rounds) == sorted(end.rounds, reverse=True)
    assert recall(end) >= 0.9 and recall(start) <= recall(end) - 0.2


def test_crowded_home(spark, monkeypatch):
    """Homes with many guests, and buckets with many vectors, are split."""
    monkeypatch.setattr(nn, "GUESTS", 40)
    monkeypatch.setattr(nn, "BUCKET", 16)
    rng = np.random.default_rng(6)
    x = (np.eye(8)[0] + 0.05 * rng.standard_normal((400, 8))).astype(np.float32)
    v = nn.usable(spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "k long, v array<float>"), "k", "v", 8)
    got = {r.id: [n.id for n in r.nbrs[:5]] for r in nn.neighbour_graph(v).collect()}
    assert len(got) == 400 and all(len(set(a)) == 5 and i not in a for i, a in got.items())


def _written(spark):
    """Rows that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neighbours_share_homes(spark, monkeypatch):
    """A round sends a vector hardly anywhere but home where vectors lie in clusters, and doesn't shuffle the lists."""
    monkeypatch.setattr(nn, "BUCKET", 32)
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((60, 16))[rng.integers(60, size=2000)] + 0.2 * rng.standard_normal((2000, 16))).astype(np.float32)
    v = nn.usable(spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "k long, v array<float>"), "k", "v", 16)
    at = [_written(spark)]
    for rounds in (0, 1):
        nn.build(v, rounds=rounds)
        at.append(_written(spark))
    assert (at[2] - at[1]) - (at[1] - at[0]) < 2.5 * 2000 + 2000  # visits, and what is found by them


def test_met(monkeypatch):
    """All pairs with a key in common, whatever the number compared at a time; a key with many members is split."""
    rng = np.random.default_rng(9)
    member, key = np.divmod(np.unique(rng.integers(50 * 20, size=300)), 20)
    hashes = rng.integers(-(1 << 31), 1 << 31, 50)
    want = {(a, b) for a, k in zip(member, key) for b, m in zip(member, key) if k == m and a < b}
    for at_once in (1, 7, 10_000):
        monkeypatch.setattr(nn, "PAIRS", at_once)
        assert {p for a, b in nn._met(member, key, hashes) for p in zip(a.tolist(), b.tolist())} == want
    monkeypatch.setattr(nn, "GUESTS", 5)
    some = {p for a, b in nn._met(member, key, hashes) for p in zip(a.tolist(), b.tolist())}
    assert some < want and len(some) > 0.1 * len(want)
    assert [len(a) for a, _ in nn._met(np.arange(3), np.arange(3), hashes)] == [0]
