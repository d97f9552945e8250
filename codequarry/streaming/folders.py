"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="spark-")
