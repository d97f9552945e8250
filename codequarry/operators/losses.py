"""Losses of retrieval training as queries over score matrices in long form.

Inputs are pairs of a batch: (batch, i, q, p) with the vectors of query and positive of place i, in double precision; hard negatives are (batch, j, n).
Each loss is one row a batch: (batch, loss, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import dot

MASKED = 10_000.0


def score_matrix(a: DataFrame, av: str, b: DataFrame, bv: str, mask_diagonal: bool = False) -> DataFrame:
    """(batch, i, j, s): the dot products of all a and b of a batch; mask_diagonal takes 10000 from i = j."""
    left = a.select("batch", "i", F.col(av).alias("_a"))
    right = b.select("batch", F.col("i").alias("j"), F.col(bv).alias("_b"))
    s = dot(F.col("_a"), F.col("_b"))
    if mask_diagonal:
        s = F.when(F.col("i") == F.col("j"), s - MASKED).otherwise(s)
    return left.join(right, "batch").select("batch", "i", "j", s.alias("s"))


def cross_entropy(scores: DataFrame, row: str = "i", temperature: float = 0.05) -> DataFrame:
    """(batch, row, ce): logsumexp of a row's scores less its target's. scores: (batch, i, j, s, target boolean)."""
    t = scores.select("batch", F.col(row).alias("row"), (F.col("s") / temperature).alias("s"), "target")
    top = t.groupBy("batch", "row").agg(F.max("s").alias("m"), F.max(F.when(F.col("target"), F.col("s"))).alias("own"))
    total = t.join(top, ["batch", "row"]).groupBy("batch", "row").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"), F.first("m").alias("m"), F.first("own").alias("own"))
    return total.select("batch", "row", (F.col("m") + F.log("z") - F.col("own")).alias("ce"))


def _with_target(scores: DataFrame, target: Column | bool) -> DataFrame:
    return scores.withColumn("target", target if isinstance(target, Column) else F.lit(target))


def _mean(ce: DataFrame, name: str) -> DataFrame:
    return ce.groupBy("batch").agg(F.avg("ce").alias(name))


def _own() -> Column:
    return F.col("i") == F.col("j")


def infonce(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(batch, loss): mean cross-entropy of the queries' rows."""
    qp = _with_target(score_matrix(pairs, "q", pairs, "p"), _own())
    return _mean(cross_entropy(qp, "i", temperature), "loss")


def _two_ways(rows: DataFrame, columns: DataFrame, how: str) -> DataFrame:
    both = _mean(rows, "r").join(_mean(columns, "c"), "batch")
    return both.select("batch", ((F.col("r") + F.col("c")) / (2 if how == "mean" else 1)).alias("loss"))


def clip(pairs: DataFrame, negatives: DataFrame | None = None, temperature: float = 0.05, reduce_dirs: str = "mean") -> DataFrame:
    """Both directions; hard negatives widen the rows of the queries only. reduce_dirs: mean or sum of the directions."""
    qp = _with_target(score_matrix(pairs, "q", pairs, "p"), _own())
    rows = qp if negatives is None else qp.unionByName(_with_target(score_matrix(pairs, "q", negatives, "n"), False))
    return _two_ways(cross_entropy(rows, "i", temperature), cross_entropy(qp, "j", temperature), reduce_dirs)


def gte(pairs: DataFrame, negatives: DataFrame | None = None, temperature: float = 0.05, reduce_dirs: str = "mean") -> DataFrame:
    """As clip, with the queries' own scores beside the rows and the positives' beside the columns, self-pairs masked."""
    qp = _with_target(score_matrix(pairs, "q", pairs, "p"), _own())
    rows = qp.unionByName(_with_target(score_matrix(pairs, "q", pairs, "q", True), False))
    if negatives is not None:
        rows = rows.unionByName(_with_target(score_matrix(pairs, "q", negatives, "n"), False))
    turned = qp.select("batch", F.col("j").alias("i"), F.col("i").alias("j"), "s", "target")
    columns = turned.unionByName(_with_target(score_matrix(pairs, "p", pairs, "p", True), False))
    return _two_ways(cross_entropy(rows, "i", temperature), cross_entropy(columns, "i", temperature), reduce_dirs)


def false_negative_masked(pairs: DataFrame, temperature: float = 0.05, margin: float = 0.1) -> DataFrame:
    """(batch, loss, n_masked): rows [qp, qq, pp], where scores above the row's own plus ``margin`` are masked as false negatives, as self-pairs are."""
    own = score_matrix(pairs, "q", pairs, "p").filter(_own()).select("batch", "i", F.col("s").alias("own"))

    def masked(scores: DataFrame, self_pairs: bool) -> DataFrame:
        s = scores.join(own, ["batch", "i"])
        false = (F.col("s") > F.col("own") + margin) & ~_own()
        return s.select("batch", "i", "j", F.when(false, -MASKED).otherwise(F.col("s")).alias("s"), (~F.lit(self_pairs) & _own()).alias("target"), false.alias("false"))

    every = masked(score_matrix(pairs, "q", pairs, "p"), False).unionByName(masked(score_matrix(pairs, "q", pairs, "q", True), True)).unionByName(masked(score_matrix(pairs, "p", pairs, "p", True), True))
    loss = _mean(cross_entropy(every, "i", temperature), "loss")
    return loss.join(every.groupBy("batch").agg(F.sum(F.col("false").cast("long")).alias("n_masked")), "batch")


def kl(candidates: DataFrame, student_temperature: float = 1.0, teacher_temperature: float = 1.0) -> DataFrame:
    """(batch, loss): the mean over queries of KL(teacher || student) over the softmax of their candidates. candidates: (batch, query, student, teacher)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("batch", "query")

    def log_softmax(c: str, t: float) -> tuple[Column, Column]:
        x = F.col(c) / t
        return x, F.max(x).over(w)

    s, sm = log_softmax("student", student_temperature)
    t, tm = log_softmax("teacher", teacher_temperature)
    a = candidates.select("batch", "query", s.alias("s"), t.alias("t"), sm.alias("sm"), tm.alias("tm"))
    b = a.withColumn("sz", F.sum(F.exp(F.col("s") - F.col("sm"))).over(w)).withColumn("tz", F.sum(F.exp(F.col("t") - F.col("tm"))).over(w))
    ls = F.col("s") - F.col("sm") - F.log("sz")
    lt = F.col("t") - F.col("tm") - F.log("tz")
    return b.select("batch", "query", (F.exp(lt) * (lt - ls)).alias("d")).groupBy("batch").agg((F.sum("d") / F.countDistinct("query")).alias("loss"))


def mix(contrastive: DataFrame, distilled: DataFrame, w_contrastive: float, w_kl: float) -> DataFrame:
    """(batch, loss): the weighted sum of two losses."""
    return contrastive.select("batch", F.col("loss").alias("_c")).join(distilled.select("batch", F.col("loss").alias("_k")), "batch").select("batch", (w_contrastive * F.col("_c") + w_kl * F.col("_k")).alias("loss"))
