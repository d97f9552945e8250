"""Operators on spans of a text: taking out comments, grouping comment lines, joining comments with functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def strip_spans(content: Column, spans: Column) -> Column:
    """The UTF-8 text without the byte ranges ``spans`` (structs with start_byte and end_byte, in any order; overlaps are taken out once)."""
    data = F.encode(content, "UTF-8")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start_byte"].cast("int").alias("a"), x["end_byte"].cast("int").alias("b"))))
    zero = F.struct(F.encode(F.lit(""), "UTF-8").alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        piece = F.substring(data, s["at"] + 1, F.greatest(x["a"] - s["at"], F.lit(0)))
        return F.struct(F.concat(s["kept"], piece).alias("kept"), F.greatest(s["at"], x["b"]).alias("at"))

    rest = F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<a:int,b:int>>")), zero, step)
    return F.concat(rest["kept"], F.substring(data, rest["at"] + 1, 1 << 30)).cast("string")


def removed_before(position: Column, spans: Column) -> Column:
    """How many bytes the ranges take away before a position outside them: what a surviving span moves by."""
    before = F.filter(spans, lambda x: x["end_byte"] <= position)
    return F.aggregate(before, F.lit(0), lambda s, x: s + (x["end_byte"] - x["start_byte"]).cast("int"))


def at_line_start(content: Column, start_byte: Column, column: Column, strict: bool = True) -> Column:
    """Does only white space stand before a span on its line? strict: not at column 0, where there is nothing before it."""
    return blank_before(F.encode(content, "UTF-8"), start_byte, column, strict)


def blank_before(data: Column, start_byte: Column, column: Column, strict: bool = True) -> Column:
    """at_line_start() on the text's bytes."""
    before = F.substring(data, start_byte - column + 1, column).cast("string")
    blank = F.regexp_like(before, F.lit(r"^\s+$")) if strict else F.regexp_like(before, F.lit(r"^\s*$"))
    return F.coalesce(blank, F.lit(False))


def group_lines(comments: DataFrame, file: str = "file_id", min_group_size: int = 1) -> DataFrame:
    """Runs of comment lines on adjacent rows, as gaps and islands: columns file, id, start_byte, end_byte, start_row, end_row, n.

    comments: single-line ones, with file, id, start_byte, end_byte, start_row, end_row, line_start. A run begins where the row isn't the one below the
    previous comment's, or either is not at the start of its line; id and start come from its first comment, the end from its last.
    """
    w = W.partitionBy(file).orderBy("start_byte", "id")
    joined = F.col("line_start") & F.lag("line_start").over(w) & (F.col("start_row") - F.lag("start_row").over(w) == 1)
    islands = comments.withColumn("_b", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_b").over(w))
    by = F.struct("start_byte", "id")
    runs = islands.groupBy(file, "_g").agg(F.min_by("id", by).alias("id"), F.min("start_byte").alias("start_byte"), F.max_by("end_byte", by).alias("end_byte"), F.min_by("start_row", by).alias("start_row"), F.max_by("end_row", by).alias("end_row"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= min_group_size).drop("_g")


def join_comments(comments: DataFrame, functions: DataFrame, file: str = "file_id", depth: int = 3) -> DataFrame:
    """Each comment with each function that it documents: (file, comment_id, function_id).

    It documents a function that begins on the row below its end, or that holds it and begins at most ``depth`` rows above it. As two equi-joins, each on the
    file and a row, instead of one join by file with both conditions.
    """
    c = comments.select(F.col(file).alias("_f"), F.col("id").alias("comment_id"), F.col("start_byte").alias("ca"), F.col("end_byte").alias("cb"), F.col("start_row").alias("cr"), F.col("end_row").alias("ce"))
    f = functions.select(F.col(file).alias("_f"), F.col("id").alias("function_id"), F.col("start_byte").alias("fa"), F.col("end_byte").alias("fb"), F.col("start_row").alias("_row"))
    above = c.withColumn("_row", F.col("ce") + 1).join(f, ["_f", "_row"])
    near = f.withColumn("_row", F.explode(F.sequence(F.col("_row"), F.col("_row") + depth)))
    inside = c.withColumn("_row", F.col("cr")).join(near, ["_f", "_row"]).filter((F.col("fa") <= F.col("ca")) & (F.col("cb") <= F.col("fb")))
    keep = [F.col("_f").alias(file), "comment_id", "function_id"]
    return above.select(*keep).unionByName(inside.select(*keep)).distinct()
