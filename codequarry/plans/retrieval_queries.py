"""Queries of retrieval, evaluation and annotation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays as A, text as T
from ..operators import annotate, dense, evaluate, tfidf
from . import registry


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Each function once, whatever its deliveries."""
    return _table(spark, d, "corpus").filter("function IS NOT NULL").groupBy("url").agg(F.min("function").alias("function"), F.min("lang").alias("lang"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The queries of a search: those whose id is divisible by 100, each once."""
    return _table(spark, d, "annotation").filter("query IS NOT NULL AND query_id % 100 = 0").groupBy("query_id").agg(F.min("query").alias("query"), F.min("lang").alias("lang"))


def _top(spark: SparkSession, d: str, analyzer: str, scope: list[str] | None = None, k: int = 10) -> DataFrame:
    functions = _table(spark, d, "corpus").filter("function IS NOT NULL")
    return tfidf.retrieve(_asked(spark, d), functions, k, analyzer, "query_id", "query", "url", "function", scope, least=True)


def tfidf_topk_v1(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "v1").select("query", "doc", "score", "rank")


def tfidf_topk_v2(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "v2").select("query", "doc", "score", "rank")


def tfidf_topk_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "v1", ["lang"]).select("lang", "query", "doc", "score", "rank")


def tfidf_topk_padded(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return tfidf.padded(_top(spark, d, "v2", k=1000), _asked(spark, d), 1000, corpus.agg(F.max("url").alias("doc")))


def analyzer_v1_counts(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_counts(_corpus(spark, d), "url", "function", "v1").groupBy("doc").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_grams"))


def analyzer_v2_counts(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_counts(_corpus(spark, d), "url", "function", "v2").groupBy("doc").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_grams"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).filter("lang IS NOT NULL")
    idf = tfidf.fit_idf(tfidf.term_counts(c, "url", "function", "v1", ["lang"]), c.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ["lang"])
    return idf.select("lang", "term", "df", F.round("idf", 6).alias("idf"))


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return e.filter("vec_id % 100 = 0"), e


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    q, e = _embeddings(spark, d)
    return dense.dense_top_k(q, e, 10, "vec_id", "embedding", "vec_id", "embedding")


def dense_topk_matryoshka(spark: SparkSession, d: str) -> DataFrame:
    q, e = (x.withColumn("v", A.first_dimensions(F.col("embedding"), 16)) for x in _embeddings(spark, d))
    return dense.dense_top_k(q, e, 10, "vec_id", "v", "vec_id", "v")


def dense_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    q, e = _embeddings(spark, d)
    return dense.dense_top_k(q, e, 5, "vec_id", "embedding", "vec_id", "embedding", "label")


def normalised_norms(spark: SparkSession, d: str) -> DataFrame:
    v = A.normalise(F.col("function_vec"))
    t = _table(spark, d, "corpus").filter("size(function_vec) > 0 AND forall(function_vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf')) AND exists(function_vec, x -> x <> 0)")
    return t.groupBy("vec_id").agg(F.round(F.max(A.dot(v, v)), 6).alias("norm"))


def hashed_embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d).select(F.col("url").alias("id"), F.col("function").alias("text"))
    asked = _asked(spark, d).select(F.col("query_id").alias("query"), F.col("query").alias("question"))
    return registry.predict(registry.compose("hashed-words"), asked, corpus)


# ---- judged predictions


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row a prediction: what stands in the candidates, with hits by the judge's answer and by the label."""
    hit = F.transform("candidates", lambda x: F.struct(x["score"].alias("score"), (T.answer_to_label(x["answer-qwen3-32b-think"]) == 1).alias("hit")))
    gold = F.transform("candidates", lambda x: F.struct(x["score"].alias("score"), F.array_contains(F.col("label"), x["id"]).alias("hit")))
    return _table(spark, d, "predictions").select("prediction_id", "version", "bench", "lang", hit.alias("judged"), gold.alias("gold"))


def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mrr(_predictions(spark, d), ["version", "bench", "lang"], 10, "judged").withColumn("score", F.round("score", 6))


def mrr_by_label(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mrr(_predictions(spark, d), ["version", "bench"], 10, "gold").withColumn("score", F.round("score", 6))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mrr(_predictions(spark, d), ["version", "bench", "lang"], 10, "judged").drop("n")


def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mean_of_means(_scores(spark, d), ["version"], ["bench"]).withColumn("score", F.round("score", 6))


def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).groupBy("version", "bench").agg(F.avg("score").alias("score"))
    p = evaluate.pivot(s, "version", "bench", list(registry.BENCHES))
    return p.select("version", *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("-", "_")) for c in p.columns[1:]))


def best_flag(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).groupBy("version", "bench").agg(F.round(F.avg("score"), 6).alias("score"))
    return evaluate.best_flag(s, ["bench"])


def judge_label(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "predictions").select("prediction_id", F.posexplode("candidates").alias("_p", "_c"))
    return t.select("prediction_id", (F.col("_p") + 1).cast("long").alias("rank"), T.answer_to_label(F.col("_c")["answer-qwen3-32b-think"]).cast("long").alias("label"))


def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return annotate.top_pairs(_table(spark, d, "predictions"), 10).select(F.md5("question").alias("question"), F.md5("text").alias("text"))


def annotate_back(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "predictions")
    answers = annotate.judge_pairs(annotate.top_pairs(p, 10), annotate.overlap_judge)
    return annotate.put_back(p, answers, 10, ["prediction_id"]).select("prediction_id", "rank", "id", "answer")


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    pairs = annotate.top_pairs(_table(spark, d, "predictions"), 10)
    filled = annotate.prompt(F.col("question"), F.col("text"), ("Query: ", "\nCode: ", "\nAnswer yes or no."))
    return pairs.select(F.md5(filled).alias("prompt"))


def audit_missing(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "predictions")
    expected = p.select("version").distinct().crossJoin(p.select("bench").distinct())
    return evaluate.audit(expected, p, ["version", "bench"])


def bijection_check(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.is_bijection(_table(spark, d, "corpus"), "url", "vec_id")


def subset_check(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "annotation").select(F.explode("urls").alias("url"))
    return evaluate.is_proper_subset(asked, _table(spark, d, "corpus"), "url")


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.jsonl import nest_candidates

    p = _table(spark, d, "predictions").select(F.col("prediction_id").alias("query"), "question", "label", "lang", "candidates")
    flat = p.select("query", F.posexplode("candidates").alias("_p", "_c")).select("query", F.col("_p").alias("rank"), "_c.id", "_c.text", "_c.score")
    n = nest_candidates(flat, p.drop("candidates"))
    return n.select("query", F.size("candidates").cast("long").alias("n"), F.get("candidates", 0)["id"].alias("first_id"))


_CORPUS = "(SELECT url, min(function) AS function, min(lang) AS lang FROM corpus WHERE function IS NOT NULL GROUP BY url)"
_ASKED = "(SELECT query_id, min(query) AS query, min(lang) AS lang FROM annotation WHERE query IS NOT NULL AND query_id % 100 = 0 GROUP BY query_id)"
_V1 = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_SPLITS = r"(CASE WHEN len(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+')) > 0 THEN regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+') ELSE [w] END)"
_V2 = r"list_transform(flatten(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda w: " + _SPLITS.replace("{", "{{").replace("}", "}}") + ")), lambda x: lower(x))"


def _sql_grams(words: str) -> str:
    return f"SELECT k, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM ({words})"


def _sql_counts(analyzer: str, table: str, key: str, text: str) -> str:
    words = (_V1 if analyzer == "v1" else _V2).format(text)
    return f"SELECT k, lang, term, count(*) AS tf FROM ({_sql_grams(f'SELECT {key} AS k, lang, {words} AS w FROM {table}')}) GROUP BY k, lang, term"


def _sql_top(analyzer: str, scoped: bool, k: int = 10) -> str:
    same = "d.lang = {0}.lang AND " if scoped else ""
    n = "(SELECT lang, count(*) AS n FROM c GROUP BY lang)" if scoped else "(SELECT count(*) AS n FROM c)"
    on = "ON d.lang = n.lang" if scoped else "ON true"
    return f"""WITH c AS {_CORPUS}, d AS ({_sql_counts(analyzer, 'c', 'url', 'function')}), q AS ({_sql_counts(analyzer, _ASKED, 'query_id', 'query')}),
f AS (SELECT {'d.lang, ' if scoped else ''}term, count(*) AS df, any_value(n.n) AS n FROM d JOIN {n} n {on} GROUP BY {'d.lang, ' if scoped else ''}term),
i AS (SELECT {'lang, ' if scoped else ''}term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM f),
dw AS (SELECT d.k, d.lang, d.term, d.tf * i.idf AS w FROM d JOIN i ON {same.format('i')}d.term = i.term), dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM dw GROUP BY k),
qw AS (SELECT d.k, d.lang, d.term, d.tf * i.idf AS w FROM q d JOIN i ON {same.format('i')}d.term = i.term), qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM qw GROUP BY k),
s AS (SELECT {'d.lang, ' if scoped else ''}qw.k AS query, d.k AS doc, round(sum(qw.w * d.w) / any_value(qn.n) / any_value(dn.n), 6) AS score FROM qw JOIN dw d ON {same.format('qw')}d.term = qw.term JOIN qn ON qn.k = qw.k JOIN dn ON dn.k = d.k GROUP BY {'d.lang, ' if scoped else ''}qw.k, d.k)
SELECT {'lang, ' if scoped else ''}query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= {k}"""


def _sql_dense(v: str, where: str = "true", k: int = 10) -> str:
    return f"""WITH e AS (SELECT vec_id, label, {v} AS v FROM embeddings)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS doc, round(list_dot_product(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


_LABEL = """CASE WHEN starts_with({0}, 'yes') THEN 1 WHEN starts_with({0}, 'no') THEN 0 ELSE -1 END"""
_REST = r"regexp_replace(lower(substr(a, strpos(a, '</think>') + 8)), '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{3000}]+', '')"
_JUDGED = """SELECT prediction_id, version, bench, lang, label, i AS rank, candidates[i].id AS id, candidates[i].score AS score, candidates[i]."answer-qwen3-32b-think" AS a FROM (SELECT *, unnest(range(1, len(candidates) + 1)) AS i FROM predictions)"""
_LABELLED = f"SELECT *, CASE WHEN strpos(a, '</think>') > 0 THEN {_LABEL.format(_REST)} ELSE -1 END AS j FROM ({_JUDGED})"


def _sql_mrr(by: str, hit: str) -> str:
    join = " AND ".join(f"p.{x} IS NOT DISTINCT FROM r.{x}" for x in ("prediction_id",))
    return f"""SELECT {by}, count(*) AS n, avg(coalesce(r.rr, 0.0)) AS score FROM predictions p LEFT JOIN (SELECT prediction_id, 1.0 / min(place) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY score DESC, rank) AS place FROM ({_LABELLED})) WHERE place <= 10 AND {hit} GROUP BY prediction_id) r ON {join} GROUP BY {by}"""


_MRR = _sql_mrr("version, bench, lang", "j = 1")
_BENCH = f"SELECT version, bench, avg(score) AS score FROM ({_MRR}) GROUP BY version, bench"
_CELLS = ", ".join(f"round(max(CASE WHEN bench = '{b}' THEN score END), 6) AS {b.replace('-', '_')}" for b in sorted(registry.BENCHES))

ORACLES = {
    "tfidf_topk_v1": _sql_top("v1", False),
    "tfidf_topk_v2": _sql_top("v2", False),
    "tfidf_topk_by_lang": _sql_top("v1", True),
    "tfidf_topk_padded": f"SELECT query_id AS query, r AS rank, coalesce(t.doc, (SELECT max(url) FROM {_CORPUS})) AS doc, coalesce(t.score, -100.0) AS score FROM (SELECT query_id, unnest(range(1, 1001)) AS r FROM {_ASKED}) q LEFT JOIN ({_sql_top('v2', False, 1000)}) t ON t.query = q.query_id AND t.rank = q.r",
    "analyzer_v1_counts": f"SELECT k AS doc, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams FROM ({_sql_counts('v1', _CORPUS, 'url', 'function')}) GROUP BY k",
    "analyzer_v2_counts": f"SELECT k AS doc, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams FROM ({_sql_counts('v2', _CORPUS, 'url', 'function')}) GROUP BY k",
    "idf_table": f"WITH c AS (SELECT * FROM {_CORPUS} WHERE lang IS NOT NULL), d AS ({_sql_counts('v1', 'c', 'url', 'function')}) SELECT d.lang, term, count(*) AS df, round(ln((1.0 + any_value(n.n)) / (1.0 + count(*))) + 1.0, 6) AS idf FROM d JOIN (SELECT lang, count(*) AS n FROM c GROUP BY lang) n ON d.lang = n.lang GROUP BY d.lang, term",
    "dense_topk": _sql_dense("CAST(embedding AS DOUBLE[])"),
    "dense_topk_matryoshka": _sql_dense("list_transform(CAST(embedding AS DOUBLE[])[1:16], lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[])[1:16], CAST(embedding AS DOUBLE[])[1:16])))"),
    "dense_topk_by_label": _sql_dense("CAST(embedding AS DOUBLE[])", "q.label = e.label", 5),
    "normalised_norms": "SELECT DISTINCT vec_id, CAST(1 AS DOUBLE) AS norm FROM corpus WHERE len(function_vec) > 0 AND len(list_filter(function_vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(function_vec, lambda x: x <> 0)) > 0",
    "mrr_at_k": f"SELECT version, bench, lang, n, round(score, 6) AS score FROM ({_MRR})",
    "mrr_by_label": f"SELECT version, bench, n, round(score, 6) AS score FROM ({_sql_mrr('version, bench', 'list_contains(label, id)')})",
    "mean_of_means": f"SELECT version, round(avg(score), 6) AS score FROM ({_BENCH}) GROUP BY version",
    "score_pivot": f"SELECT version, {_CELLS}, round(avg(score), 6) AS AVG FROM ({_BENCH}) GROUP BY version",
    "best_flag": f"SELECT version, bench, score, score = max(score) OVER (PARTITION BY bench) AS is_best FROM (SELECT version, bench, round(score, 6) AS score FROM ({_BENCH}))",
    "judge_label": f"SELECT prediction_id, rank, CAST(j AS BIGINT) AS label FROM ({_LABELLED})",
    "distinct_pairs": "SELECT md5(question) AS question, md5(text) AS text FROM (SELECT DISTINCT question, c.text AS text FROM (SELECT question, unnest(list_slice(candidates, 1, 10)) AS c FROM predictions))",
    "annotate_back": """WITH f AS (SELECT prediction_id, question, i AS rank, candidates[i].id AS id, candidates[i].text AS text FROM (SELECT *, unnest(range(1, len(candidates) + 1)) AS i FROM predictions))
SELECT prediction_id, rank, id, CASE WHEN rank <= 10 THEN CASE WHEN 3 * len(list_filter(list_distinct(w), lambda x: contains(lower(coalesce(text, '')), x))) >= len(list_distinct(w)) THEN 'yes' ELSE 'no' END END AS answer FROM (SELECT *, list_filter(string_split_regex(lower(coalesce(question, '')), '\\s+'), lambda x: x <> '') AS w FROM f)""",
    "prompt_assembly": """SELECT md5('Query: ' || array_to_string(list_slice(list_filter(string_split_regex(question, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''), 1, 64), ' ') || chr(10) || 'Code: ' || array_to_string(list_slice(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''), 1, 2048), ' ') || chr(10) || 'Answer yes or no.') AS prompt FROM (SELECT DISTINCT question, c.text AS text FROM (SELECT question, unnest(list_slice(candidates, 1, 10)) AS c FROM predictions))""",
    "audit_missing": "SELECT v.version, b.bench FROM (SELECT DISTINCT version FROM predictions) v CROSS JOIN (SELECT DISTINCT bench FROM predictions) b WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.version = v.version AND p.bench = b.bench)",
    "bijection_check": "SELECT count(*) = count(DISTINCT url) AND count(*) = count(DISTINCT vec_id) AS is_bijection FROM (SELECT DISTINCT url, vec_id FROM corpus)",
    "subset_check": "WITH a AS (SELECT DISTINCT unnest(urls) AS url FROM annotation) SELECT (SELECT count(*) FROM a WHERE url NOT IN (SELECT url FROM corpus)) = 0 AS is_subset, (SELECT count(*) FROM a WHERE url NOT IN (SELECT url FROM corpus)) = 0 AND (SELECT count(*) FROM a) < (SELECT count(DISTINCT url) FROM corpus) AS is_proper",
    "prediction_rows": "SELECT prediction_id AS query, CAST(coalesce(len(candidates), 0) AS BIGINT) AS n, candidates[1].id AS first_id FROM predictions",
}
QUERIES = {f.__name__: f for f in (tfidf_topk_v1, tfidf_topk_v2, tfidf_topk_by_lang, tfidf_topk_padded, analyzer_v1_counts, analyzer_v2_counts, idf_table, dense_topk, dense_topk_matryoshka, dense_topk_by_label, normalised_norms, hashed_embedding_topk, mrr_at_k, mrr_by_label, mean_of_means, score_pivot, best_flag, judge_label, distinct_pairs, annotate_back, prompt_assembly, audit_missing, bijection_check, subset_check, prediction_rows)}
