from codequarry.operators import parse, sampling
from codequarry.plans import registry
import time


def test_numbered(spark):
    """Splits are many, one of them hot; the numbers are those of the order."""
    rows = [(f"s{i % 3 and 1}", i * i) for i in range(300)] + [("s2", 5), (None, 7), ("s2", None)]
    df = spark.createDataFrame(rows, "s string, k long")
    got = {(r.s, r.k): r["_r"] for r in sampling.numbered(df, "k", ["s"], rows=20).collect()}
    for s in {r[0] for r in rows}:
        own = sorted((r[1] for r in rows if r[0] == s), key=lambda k: (k is not None, k))
        assert [got[s, k] for k in own] == list(range(1, len(own) + 1))
    assert sampling.numbered(df.limit(0), "k", ["s"]).count() == 0
    least = sampling.equalise(df.filter("s IS NOT NULL"), "s", "k")
    assert {r.s: r["count"] for r in least.groupBy("s").count().collect()} == {"s0": 2, "s1": 2, "s2": 2}


def test_batches_of_many_splits(spark):
    df = spark.range(1000)
    want = {r.id: (r.batch_id, r.place) for r in sampling.batches(df, "id", 7, 3).collect()}
    assert {r.id: (r.batch_id, r.place) for r in sampling.batches(df, "id", 7, 3, rows=10).collect()} == want


def test_signatures_end():
    for language in ("C", "C++"):
        began = time.process_time()
        parse.parse("a " + "* " * 5_000 + "\n" + "int f(int x) {\n  return x;\n}\n", language)
        assert time.process_time() - began < 5
    snippets, _ = parse.parse("// é\nstatic char *f(int x) {\n  return 0;\n}\n", "C")
    assert [(s["identifier"], s["start_byte"], s["end_byte"], s["start_point"]) for s in snippets] == [("f", 6, 43, [1, 0])]


def test_public_retrievers():
    assert len(registry.RETRIEVERS) == 20  # nineteen and the one that needs no model
    run = registry.compose("nomic-ai--CodeRankEmbed")
    assert run.kind == "dense" and run.options["embedder"] == "nomic-ai/CodeRankEmbed" and run.query_prefix.startswith("Represent this query")
