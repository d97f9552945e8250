"""Samples that come out the same each time: order by the MD5 of seed and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def order_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def batches(df: DataFrame, key: str, size: int, seed: int = 0, drop_last: bool = False, rows: int = 500_000) -> DataFrame:
    """The rows with batch_id and place: all rows in the order of their hash, cut into batches of ``size``.

    The hash's first characters range-split the rows, ``rows`` to a split, so that they are numbered in parallel: a row's number is its rank in its split behind the
    sizes of the splits before (of which only the counts are gathered). drop_last: leave the last batch out if it isn't full.
    """
    keyed = df.withColumn("_h", order_key(seed, key))
    salts = max(1, -(-df.count() // rows))
    keyed = keyed.withColumn("_s", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * salts / (1 << 32)).cast("int"))
    sizes = keyed.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))  # one row a split
    numbered = keyed.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_h", key))).join(F.broadcast(before.drop("_n")), "_s")
    n = F.col("_b") + F.col("_r") - 1
    out = numbered.withColumn("batch_id", F.floor(n / size).cast("long")).withColumn("place", (n % size).cast("long"))
    if drop_last:
        out = out.filter((F.col("batch_id") + 1) * size <= F.col("_all"))
    return out.drop("_h", "_s", "_b", "_r", "_all")


def choose(items: Column, key: Column, seed: int, k: int = 1) -> Column:
    """k elements of an array without replacement: those of the least hash of seed, key and place; fewer if there are fewer."""
    n = F.size(items)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    ordered = F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.element_at(items, x["i"]))


def sample_without_replacement(queries: DataFrame, docs: DataFrame, query: str, doc: str, m: int, seed: int = 228) -> DataFrame:
    """(query, doc): for each query, the m documents of the least hash, all where there are fewer. Queries are a stated set, sent to the documents' tasks if they are small.

    Up to the session's windowGroupLimitThreshold (1,000), each task keeps its m least a query before the shuffle.
    """
    every = docs.select(F.col(doc).alias("doc")).crossJoin(queries.select(F.col(query).alias("query")))
    w = W.partitionBy("query").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query").cast("string"), F.col("doc").cast("string"))), "doc")
    return every.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m).drop("_r").select("query", "doc")


def sample_with_replacement(queries: DataFrame, n_docs: int, query: str, m: int, seed: int = 228) -> DataFrame:
    """(query, draw, place): m draws a query of a document's place, 0 to n_docs - 1."""
    draws = queries.select(F.col(query).alias("query"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(m).cast("long"))).alias("draw"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query").cast("string"), F.col("draw").cast("string")))
    return draws.withColumn("place", F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n_docs)


def numbered(df: DataFrame, key: str, by: list[str] | None = None, rows: int = 500_000) -> DataFrame:
    """The rows with _r, their number from 1 on in the order of the numeric key, within each group of ``by`` if it's given; null keys come first.

    The keys' range is cut into equal splits, so many that ``rows`` of a group would be in each if keys are spread evenly; each split is numbered by itself, behind the
    counts of the splits before. Of these only the counts are gathered, a row a group and split.
    """
    by = by or []
    size = df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).first()
    splits = max(1, -(-size.n // rows))
    a, b = (size.a or 0), (size.b or 0)
    width = (b - a + 1) / splits
    cut = df.withColumn("_split", F.coalesce(F.floor((F.col(key) - F.lit(a)) / F.lit(width)), F.lit(-1)).cast("long"))
    before = W.partitionBy(*by).orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "_split").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    first = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_split").alias("_same"), "_before")
    same = F.col("_split") == F.col("_same")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = cut.withColumn("_i", F.row_number().over(W.partitionBy(*by, "_split").orderBy(key))).join(first, same)
    return out.withColumn("_r", F.col("_before") + F.col("_i")).drop("_split", "_same", "_before", "_i", *(f"_by_{c}" for c in by))


def equalise(df: DataFrame, shard: str, key: str) -> DataFrame:
    """The rows of each shard up to the size of the smallest, in the order of the numeric key. A shard of any size is numbered in splits."""
    least = df.groupBy(shard).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_m"))
    return numbered(df, key, [shard]).crossJoin(F.broadcast(least)).filter(F.col("_r") <= F.col("_m")).drop("_r", "_m")
