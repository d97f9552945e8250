import time

from codequarry.llm import lineage


def _shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_are_removed(spark):
    """At the end of a step, though the driver still holds the plan that it came from; the session's setting stays as it was."""
    setting, before = spark.conf.get(lineage.CLEANUP, None), _shuffles(spark)
    df = spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count()
    got = lineage.materialised(df)
    for _ in range(20):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert {(r.k, r["count"]) for r in got.collect()} == {(k, 100) for k in range(100)} == {(r.k, r["count"]) for r in df.collect()}
    assert spark.conf.get(lineage.CLEANUP, None) == setting
