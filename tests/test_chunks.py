"""TF-IDF in chunks of documents: equal to the joins by term, and without a shuffle of pairs of query and document."""

import random
import time

import pytest

from codequarry.operators import tfidf


def _shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("k", [10, 1000])
def test_pairs_stay_in_tasks(spark, k):
    docs = spark.createDataFrame([(f"d{i}", f"the list of {i % 97} and fooBar{i}") for i in range(3000)], "url string, text string")
    asked = spark.createDataFrame([(i, f"the list of {i}") for i in range(100)], "query_id long, query string")
    before = _shuffled(spark)
    n = tfidf.retrieve(asked, docs, k, "v2", doc_key="url").count()
    assert n == 100 * k
    assert _shuffled(spark) - before < 10_000 + 1.5 * n  # the pairs are 300,000, the terms of documents 36,000


def _docs(spark):
    rng = random.Random(3)
    words = ["getName", "list", "of", "the", "HTTPServer", "x1", "sort", "ключ", "名前", "_"]
    rows = [(rng.randrange(250), " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["a", "b", None])) for _ in range(400)]
    docs = spark.createDataFrame([*rows, (None, "the list", "a"), (900, None, "a"), (901, "", "b"), (902, "list of the", "a"), (903, "list of the", "a")], "doc_id int, text string, lang string")
    asked = [(i, " ".join(rng.choices([*words, "unheard"], k=4)), rng.choice(["a", "b", None])) for i in range(40)]
    return docs, spark.createDataFrame([*asked, (3, "sort", "a"), (50, None, "a"), (51, "unheard of", "c"), (52, "unheard", "a"), (None, "list", "a")], "query_id int, query string, lang string")


@pytest.mark.parametrize("scope,least,k", [(None, False, 7), (None, True, 1000), (["lang"], False, 1000), (["lang"], True, 1)])
def test_same_as_joins(spark, monkeypatch, scope, least, k):
    """Many chunks and blocks, rows of the same key, nulls, ties, unknown words."""
    monkeypatch.setattr(tfidf, "CHUNK_DOCS", 60)
    monkeypatch.setattr(tfidf, "BLOCK_BYTES", 6000)
    docs, asked = _docs(spark)
    pool = asked.select(asked.query_id.alias("query")).distinct().crossJoin(docs.select(docs.doc_id.alias("doc")).distinct())
    rows = [sorted(str(r.asDict()) for r in tfidf.retrieve(asked, docs, k, "v2", scope=scope, pool=p, least=least).collect()) for p in (None, pool)]
    assert rows[0] == rows[1] and rows[0]


def test_nothing_asked(spark):
    docs, asked = _docs(spark)
    assert tfidf.retrieve(asked.limit(0), docs, 3).count() == 0 and tfidf.retrieve(asked, docs.limit(0), 3).count() == 0


def _kept(spark):
    """Bytes of the shuffle files that are there, by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for i in range(files.size()) if (f := files.apply(i)).getName().startswith("shuffle_")}


def test_texts_are_removed(spark):
    """The texts shuffled for the frequencies of the queries' terms don't stay until the driver's garbage is collected."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{rng.randrange(10**9)}" for _ in range(50))) for i in range(2000)], "url string, text string")
    asked = spark.createDataFrame([(i, f"w{i} list") for i in range(20)], "query_id long, query string")
    before = _kept(spark)
    tfidf.retrieve(asked, docs, 3, "v2", doc_key="url")
    for _ in range(20):
        if (left := sum(n for x, n in _kept(spark).items() if x not in before)) < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000  # the texts are a million bytes
