"""Problem 4: source files that do not parse in their language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .grammar import findings
from .lexers import LANGUAGES
from .once import once_each


def parse_findings(files: DataFrame, keep: list[str], content: str = "content", language: str = "language") -> DataFrame:
    """A row (the ``keep`` columns, valid, finding, parses_as, also) for each file with content in one of the eight languages.

    valid: does it parse in its language; finding: valid, wrong_extension (it parses in ``parses_as``), merge_conflict or corrupt;
    also: the other languages whose grammars take it, the likeliest first. Every file is parsed by all eight grammars.
    An empty file is valid; null content and other or null languages have no row; repeated rows count each. Only the columns named are
    looked at, so others may have any name; of ``keep``, none may be called valid, finding, parses_as or also (ValueError).
    """
    if clash := {"valid", "finding", "parses_as", "also"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are the result's own")

    @F.pandas_udf("valid boolean, finding string, parses_as string, also array<string>")
    def judge(contents: pd.Series, langs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(once_each(findings)(contents, langs), columns=["valid", "finding", "parses_as", "also"])

    judged = files.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)), F.col(content).alias("_c"), F.col(language).alias("_l")).filter(F.col("_c").isNotNull() & F.col("_l").isin(*LANGUAGES))
    read = judged.select("*", F.explode(F.array(judge("_c", "_l"))).alias("_r"))  # exploded, so that a filter on it doesn't parse once more
    return read.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), "_r.valid", "_r.finding", "_r.parses_as", "_r.also")


def invalid_rates(files: DataFrame, by: list[str], content: str = "content", language: str = "language") -> DataFrame:
    """A row (by, n_files, n_invalid, n_wrong_extension, n_merge_conflict, n_corrupt, n_ambiguous, rate) for each group, say repository and language; null groups count as a group.

    n_ambiguous: valid files that other grammars take too.
    """

    def count(x: str):
        return F.count(F.when(F.col("finding") == x, 1)).alias(f"n_{x}")

    found = parse_findings(files, by, content, language)
    total = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(~F.col("valid"), 1)).alias("n_invalid"), count("wrong_extension"), count("merge_conflict"), count("corrupt"), F.count(F.when(F.col("valid") & (F.size("also") > 0), 1)).alias("n_ambiguous"))
    return total.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
