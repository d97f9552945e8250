"""The benchmark formats, each as queries (query, question, label, lang, scope...) and a corpus (id, text, scope...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NEEDLE = "STRUCT<query STRING, global_start_byte BIGINT, global_end_byte BIGINT>"
FUNCTION = "STRUCT<start_byte INT, end_byte INT, global_start_byte BIGINT, global_end_byte BIGINT>"
REPOQA = f"MAP<STRING, ARRAY<STRUCT<repo STRING, needles ARRAY<{NEEDLE}>, functions MAP<STRING, ARRAY<{FUNCTION}>>, content MAP<STRING, STRING>>>>"


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON document, as the column d."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))


def cosqa(spark: SparkSession, corpus_path: str, query_path: str) -> tuple[DataFrame, DataFrame]:
    """A corpus that is one object of code to number, whose numbers are to be unique, and a list of questions with their code's number."""
    corpus = _whole(spark, corpus_path, "MAP<STRING, BIGINT>").select(F.explode("d").alias("text", "id")).select("id", "text")
    q = _whole(spark, query_path, "ARRAY<STRUCT<doc STRING, code STRING, label INT, retrieval_idx BIGINT>>").select(F.posexplode("d").alias("query", "_q"))
    return q.select(F.col("query").cast("long").alias("query"), F.col("_q.doc").alias("question"), F.col("_q.retrieval_idx").alias("label"), F.lit("Python").alias("lang"), F.col("_q.code").alias("code")), corpus


def check_gold(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The questions whose code is not the text that the corpus has under their number."""
    return queries.join(corpus, queries["label"] == corpus["id"], "left").filter(~F.col("code").eqNullSafe(F.col("text"))).select("query", "label")


def csn_advtest(spark: SparkSession, masks: str) -> tuple[DataFrame, DataFrame]:
    """Rows of tokens; each is its own answer, its line's hash its number."""
    d = spark.read.schema("docstring_tokens ARRAY<STRING>, function_tokens ARRAY<STRING>").json(masks.split(","))
    d = d.select(F.array_join("docstring_tokens", " ").alias("question"), F.array_join("function_tokens", " ").alias("text"))
    d = d.withColumn("id", F.xxhash64("question", "text"))
    return d.select(F.col("id").alias("query"), "question", F.col("id").alias("label"), F.lit("Python").alias("lang")), d.select("id", "text").distinct()


def csn_original(spark: SparkSession, root: str, partition: str = "test") -> tuple[DataFrame, DataFrame]:
    """One folder a language under the root; url is the key."""
    d = spark.read.schema("partition STRING, docstring_tokens ARRAY<STRING>, code_tokens ARRAY<STRING>, url STRING").json(f"{root}/*/")
    d = d.withColumn("lang", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).filter(F.col("partition") == partition)
    d = d.select("lang", "url", F.array_join("docstring_tokens", " ").alias("question"), F.array_join("code_tokens", " ").alias("text"))
    return d.select(F.col("url").alias("query"), "question", F.col("url").alias("label"), "lang"), d.select(F.col("url").alias("id"), "text", "lang")


def csn_query(spark: SparkSession, query_masks: str, corpus_masks: str) -> tuple[DataFrame, DataFrame]:
    """One file a language, the language its base name; a query has several urls. A corpus row without text, or a url twice, counts once."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^/.]*)*$", 1)
    q = spark.read.schema("query STRING, urls ARRAY<STRING>").json(query_masks.split(",")).withColumn("lang", name)
    c = spark.read.schema("url STRING, function STRING").json(corpus_masks.split(",")).withColumn("lang", name)
    queries = q.select(F.xxhash64("lang", "query").alias("query"), F.col("query").alias("question"), F.array_sort(F.array_distinct("urls")).alias("label"), "lang")
    return queries, c.select(F.col("url").alias("id"), F.col("function").alias("text"), "lang").dropDuplicates(["lang", "id"])


def repoqa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Needles as queries, functions as corpus, both by repository; functions are cut out of the contents by bytes, their key is start_end."""
    repos = _whole(spark, path, REPOQA).select(F.explode("d").alias("lang", "_r")).select("lang", F.explode("_r").alias("_r")).select("lang", "_r.*")
    key = lambda x: F.concat_ws("_", x["global_start_byte"], x["global_end_byte"])
    queries = repos.select("lang", "repo", F.explode("needles").alias("n")).select(F.xxhash64("repo", "n").alias("query"), F.col("n.query").alias("question"), key(F.col("n")).alias("label"), "lang", "repo")
    files = repos.select("lang", "repo", "content", F.explode("functions").alias("path", "fs")).select("lang", "repo", F.col("content")[F.col("path")].alias("c"), F.explode("fs").alias("f"))
    data = F.encode("c", "UTF-8")
    text = F.substring(data, F.col("f.start_byte") + 1, F.col("f.end_byte") - F.col("f.start_byte")).cast("string")
    return queries, files.select(key(F.col("f")).alias("id"), text.alias("text"), "lang", "repo")
