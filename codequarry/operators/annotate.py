"""Judging candidates: distinct pairs, prompts, answers put back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def top_pairs(predictions: DataFrame, k: int, question: str = "question", candidates: str = "candidates") -> DataFrame:
    """(question, text): the distinct pairs of the first k candidates, in stored order, of each prediction."""
    return predictions.select(F.col(question).alias("question"), F.explode(F.slice(candidates, 1, k)).alias("_c")).select("question", F.col("_c.text").alias("text")).distinct()


def prompt(query: Column, code: Column, parts: tuple[str, str, str], query_tokens: int = 64, code_tokens: int = 2048) -> Column:
    """The three fixed parts around query and code, each cut to so many tokens; tokens are what blanks separate."""

    def cut(c: Column, n: int) -> Column:
        return F.array_join(F.slice(F.filter(F.split(c, r"\s+"), lambda x: x != ""), 1, n), " ")

    return F.concat(F.lit(parts[0]), cut(query, query_tokens), F.lit(parts[1]), cut(code, code_tokens), F.lit(parts[2]))


Judge = Callable[[list[str], list[str]], list[str]]


def judge_pairs(pairs: DataFrame, make: Callable[[], Judge]) -> DataFrame:
    """(question, text, answer): ``make`` gives each task a function from questions and texts to answers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for pdf in parts:
            yield pdf.assign(answer=judge(pdf["question"].tolist(), pdf["text"].tolist()))

    return pairs.select("question", "text").mapInPandas(run, "question string, text string, answer string")


def overlap_judge() -> Judge:
    """A judge without a model: yes if a third of the question's words stand in the text."""

    def judge(questions: list[str], texts: list[str]) -> list[str]:
        out = []
        for q, t in zip(questions, texts):
            words = set((q or "").lower().split())
            out.append("yes" if 3 * sum(w in (t or "").lower() for w in words) >= len(words) else "no")
        return out

    return judge


def put_back(predictions: DataFrame, answers: DataFrame, k: int, keys: list[str], question: str = "question", candidates: str = "candidates") -> DataFrame:
    """(keys, question, rank, id, text, score, answer): the candidates of each prediction; the first k have the answer of their pair.

    A pair of these without a row in ``answers`` is an error: the job ends. An answer that is null is kept as null.

    The join is by hash of question and text as well as by themselves, so that long texts aren't what is sorted and compared first.
    """
    flat = predictions.select(*keys, F.col(question).alias("question"), F.posexplode(candidates).alias("_p", "_c"))
    flat = flat.select(*keys, "question", (F.col("_p") + 1).cast("long").alias("rank"), F.col("_c.id").alias("id"), F.col("_c.text").alias("text"), F.col("_c.score").alias("score"))
    a = answers.select(F.xxhash64("question", "text").alias("_h"), F.col("question").alias("_q"), F.col("text").alias("_t"), F.struct("answer").alias("_a"))
    flat = flat.withColumn("_h", F.when(F.col("rank") <= k, F.xxhash64("question", "text")))
    return flat.join(a, (flat["_h"] == a["_h"]) & flat["question"].eqNullSafe(a["_q"]) & flat["text"].eqNullSafe(a["_t"]), "left").withColumn("answer", F.when((F.col("rank") <= k) & F.col("_a").isNull(), F.raise_error(F.lit("a pair has no answer")).cast(dict(answers.dtypes)["answer"])).otherwise(F.col("_a.answer"))).drop(a["_h"]).drop("_h", "_q", "_t", "_a")
