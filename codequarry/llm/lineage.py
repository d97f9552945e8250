"""Cutting lineage, so that a lost executor costs no whole chain of jobs."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffles are removed as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(df: DataFrame, adaptive: bool = True) -> DataFrame:
    """The rows, computed once and kept in the folder that spark.checkpoint.dir names; only where that is unset, as in tests, in one of our own.

    Its shuffles are removed at the end, without waiting for the driver to collect its garbage: the rows are never made again from them.
    Without ``adaptive``, the plan isn't changed as it runs, and Spark remembers by which columns the rows are partitioned: a later join by these needs no shuffle.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir"))
    conf = df.sparkSession.conf
    settings = {CLEANUP: "true"} | ({} if adaptive else {"spark.sql.adaptive.enabled": "false"})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return df.select("*").checkpoint()  # the settings count for plans made under them
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def forget(spark: SparkSession) -> None:
    """Let Spark clear away shuffles and checkpoints that nothing refers to any longer: it does so when the driver's objects are collected, here and in the JVM.

    The bridge between the two tells the JVM of what is collected here every second or so, hence the wait.
    """
    gc.collect()
    time.sleep(2)
    spark.sparkContext._jvm.System.gc()
