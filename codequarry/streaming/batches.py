"""Training batches from a stream of files: each trigger's rows are hashed into batches that don't repeat a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sampling import batches


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """JSON lines files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_batches(rows: DataFrame, key: str, size: int, out: str, checkpoint: str, seed: int = 0) -> StreamingQuery:
    """Write batches of ``size`` rows as Parquet under ``out``: a folder a trigger, with batch_id and place; each trigger is shuffled anew.

    A trigger that runs again after a failure writes its folder over, so that no row comes twice. What is in a folder at the start is taken, then the query ends.
    """

    def write(df: DataFrame, epoch: int) -> None:
        batches(df, key, size, seed + epoch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
