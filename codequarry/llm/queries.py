"""The queries of the numbered problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import docpairs, hidden_text, invalid, langid, leaks, neighbours, packing, reading, truncation

SOURCE = ["version", "bench"]
PREDICTION = ["prediction_id", "cand_rank"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, by a hash of the key, where the table's few files would leave over half of them idle; else as they come, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() < cores else df


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _spread(_table(spark, d, "parse_source_code").select("file_id", "repo_name", "language", "content"), "file_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _spread(_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fit(_table(spark, d, "documents"))
    return hidden_text.nl_spans(_files(spark, d), model)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).filter("parses AND n_sentences > 0").select("file_id", "nl_lang")


def p1_language_share(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "predictions").select("prediction_id", *SOURCE, F.posexplode("candidates").alias("_p", "_c"))
    return p.select("prediction_id", (F.col("_p") + 1).alias("cand_rank"), *SOURCE, F.col("_c")["answer-qwen3-32b-think"].alias("answer"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_answers(spark, d), PREDICTION, SOURCE, "answer").select(*PREDICTION)


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_answers(spark, d), PREDICTION, SOURCE, "answer")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    corpus, asked = _table(spark, d, "corpus"), _table(spark, d, "annotation")
    return neighbours.usable(corpus, "vec_id", "function_vec").unionByName(neighbours.usable(asked, "vec_id", "query_vec"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.neighbour_graph(_vectors(spark, d)))


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return neighbours.search(neighbours.build(vectors), vectors, vectors.filter("id % 100 = 0"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid.parse_findings(_files(spark, d), ["file_id"]).filter("NOT valid").select("file_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid.invalid_rates(_files(spark, d), ["repo_name", "language"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(_files(spark, d)).filter("parses").select("file_id", F.col("name_row").cast("int").alias("name_row"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(_files(spark, d)).filter("parses").drop("parses")


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(_documents(spark, d)), _table(spark, d, "pack_targets"))


def p6_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p6_assignment(spark, d), _table(spark, d, "pack_targets"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_documents(spark, d), _table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("run_words >= 12").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, d))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return reading.reading_levels(_documents(spark, d), reading.fit(docs, _table(spark, d, "reading_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(_levels(spark, d), _table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_language_share, p2_found, p2_rates, p3_found, p3_search, p4_found, p4_rates, p5_found, p5_pairs, p6_assignment, p6_fill_rates, p7_found, p7_leaked_items, p8_found, p8_profile)}
#: These problems have no form in SQL; tests/llm holds them against brute force, round trips and held-out labels.
ORACLES: dict[str, str] = {}
