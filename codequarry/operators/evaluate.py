"""Ranking quality: MRR by benchmark and language, means of means, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def reciprocal_rank(scores_and_hits: Column, k: int) -> Column:
    """1 / rank of the first hit among the k best, 0 if there is none. An array of structs (score, hit), sorted here by score; equal scores keep their order."""
    ordered = F.array_sort(F.transform(scores_and_hits, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x["hit"].alias("hit"))))
    at = F.array_position(F.transform(F.slice(ordered, 1, k), lambda x: x["hit"]), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def mrr(queries: DataFrame, by: list[str], k: int = 10, ranked: str = "ranked") -> DataFrame:
    """(by, n, score): the mean reciprocal rank of each group; ranked: arrays of (score, hit). Queries without candidates count with 0."""
    empty = F.coalesce(F.col(ranked), F.array().cast(dict(queries.dtypes)[ranked]))
    return queries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(reciprocal_rank(empty, k)).alias("score"))


def mean_of_means(scores: DataFrame, outer: list[str], inner: list[str]) -> DataFrame:
    """(outer, score): the mean over the inner groups' means; nulls and NaN are passed over."""
    s = scores.filter(~F.isnan("score"))
    return s.groupBy(*outer, *inner).agg(F.avg("score").alias("score")).groupBy(*outer).agg(F.avg("score").alias("score"))


def pivot(scores: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """(row, columns..., AVG): the first score of each cell and the mean of the cells there are."""
    table = scores.groupBy(row).pivot(column, sorted(columns)).agg(F.first("score"))
    return table.join(scores.groupBy(row).agg(F.avg("score").alias("AVG")), row)


def best_flag(scores: DataFrame, by: list[str]) -> DataFrame:
    """The rows with is_best: is their score the greatest of its group?"""
    return scores.withColumn("is_best", F.max("score").over(W.partitionBy(*by)) == F.col("score"))


def audit(expected: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """The expected keys that are not there."""
    return expected.select(*keys).distinct().join(there.select(*keys).distinct(), keys, "left_anti")


def is_bijection(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (is_bijection): does each a have one b and each b one a?"""
    d = df.select(a, b).distinct()
    return d.agg(((F.count(F.lit(1)) == F.countDistinct(a)) & (F.count(F.lit(1)) == F.countDistinct(b))).alias("is_bijection"))


def is_proper_subset(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """One row (is_subset, is_proper)."""
    s, g = small.select(key).distinct(), large.select(key).distinct()
    out = s.join(g, key, "left_anti").agg(F.count(F.lit(1)).alias("o")).crossJoin(s.agg(F.count(F.lit(1)).alias("s"))).crossJoin(g.agg(F.count(F.lit(1)).alias("g")))
    return out.select((F.col("o") == 0).alias("is_subset"), ((F.col("o") == 0) & (F.col("s") < F.col("g"))).alias("is_proper"))


QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, stat_min, stat_max, stat_mean, p25 ... p999): exact quantiles, linear between neighbours."""
    names = [f"p{str(q)[2:].ljust(2, '0')}" for q in QUANTILES]
    qs = [F.percentile(column, F.lit(q)).alias(n) for q, n in zip(QUANTILES, names)]
    agg = [F.min(column).alias("stat_min"), F.max(column).alias("stat_max"), F.avg(column).alias("stat_mean"), *qs]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
