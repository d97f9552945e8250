"""Training records: truncation, padding, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.arrays import mask_right, pad_right, truncate
from .sampling import batches, choose


def padded_batches(sequences: DataFrame, by: list[str], ids: str = "ids", pad: int = 0) -> DataFrame:
    """The rows with their ids padded on the right to the longest of their batch and role (``by``), and a mask of ones and zeros."""
    longest = F.max(F.size(ids)).over(W.partitionBy(*by))
    df = sequences.withColumn("_m", longest)
    return df.withColumn("mask", mask_right(F.col(ids), F.col("_m"))).withColumn(ids, pad_right(F.col(ids), F.col("_m"), pad)).drop("_m")


def contrastive_batches(records: DataFrame, key: str, size: int, max_tokens: int, eos: int, seed: int = 0, reserve_eos: bool = True) -> DataFrame:
    """(batch_id, place, key, role, ids, mask) from records (key, question, positives, negatives or not): one positive and one negative of each record,
    truncated, ended, in batches without replacement, padded by batch and role."""
    roles = {"question": F.col("question"), "positive": choose(F.col("positives"), F.col(key), seed)[0]["context"]}
    if "negatives" in records.columns:
        roles["negative"] = choose(F.col("negatives"), F.col(key), seed + 1)[0]["context"]
    put = batches(records, key, size, seed, drop_last=True)
    cells = F.array(*(F.struct(F.lit(r).alias("role"), truncate(c, max_tokens, eos, reserve_eos).alias("ids")) for r, c in roles.items()))
    flat = put.select("batch_id", "place", key, F.explode(cells).alias("_c")).select("batch_id", "place", key, "_c.role", "_c.ids")
    return padded_batches(flat, ["batch_id", "role"])


def distillation_batches(records: DataFrame, key: str, size: int, k: int, max_tokens: int, eos: int, seed: int = 0, reserve_eos: bool = False) -> DataFrame:
    """(batch_id, place, key, candidate, ids, mask, score) from records (key, question, candidates): k candidates of each record without replacement; records with fewer are an error.
    The question has candidate 0."""
    enough = F.when(F.size("candidates") >= k, F.col("candidates")).otherwise(F.raise_error(F.lit("a record has too few candidates")).cast(dict(records.dtypes)["candidates"]))
    put = batches(records.withColumn("_c", choose(enough, F.col(key), seed, k)), key, size, seed, drop_last=True)
    question = F.struct(F.lit(0).cast("long").alias("candidate"), F.col("question").alias("ids"), F.lit(None).cast("double").alias("score"))
    others = F.transform("_c", lambda x, i: F.struct((i + 1).cast("long").alias("candidate"), x["context"].alias("ids"), x["score"].cast("double").alias("score")))
    flat = put.select("batch_id", "place", key, F.explode(F.concat(F.array(question), others)).alias("_x")).select("batch_id", "place", key, "_x.candidate", truncate(F.col("_x.ids"), max_tokens, eos, reserve_eos).alias("ids"), "_x.score")
    return padded_batches(flat.withColumn("_role", F.col("candidate") > 0), ["batch_id", "_role"]).drop("_role")
