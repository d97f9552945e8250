"""Queries of sampling, batching, padding and losses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays as A
from ..operators import dense, evaluate, losses, sampling, training


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ids(c: str):
    """Token ids of a text: the lengths of its words; a vocabulary is a matter of the tokenizer."""
    return F.transform(F.filter(F.split(c, " ", -1), lambda x: x != ""), lambda x: F.char_length(x).cast("int"))


def token_truncate_eos(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "annotation").filter("query IS NOT NULL").select("query_id", _ids("query").alias("ids")).distinct()
    a, b = A.truncate(F.col("ids"), 5, 9), A.truncate(F.col("ids"), 5, 9, False)
    return t.select("query_id", F.array_join(a.cast("array<string>"), " ").alias("reserved"), F.array_join(b.cast("array<string>"), " ").alias("appended"))


def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "annotation").filter("query IS NOT NULL").select("query_id", F.floor(F.col("query_id") / 16).alias("batch_id"), _ids("query").alias("ids")).distinct()
    p = training.padded_batches(t, ["batch_id"])
    return p.select("query_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.array_join(F.col("mask").cast("array<string>"), " ").alias("mask"))


def sample_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(_table(spark, d, "documents").select("doc_id"), "doc_id", 32, 7).select("doc_id", "batch_id", "place")


def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.batches import stream_batches as start
    from ..streaming.folders import scratch

    table = _table(spark, d, "events")
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 100_000).parquet(f"{d}/events*.parquet").select("event_id")
    out = scratch(spark)
    start(rows, "event_id", 64, f"{out}/out", f"{out}/state", 5).awaitTermination()
    return spark.read.parquet(f"{out}/out").select("event_id", "batch_id", "place")


def choose_positive(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "annotation").filter("size(urls) > 0").select("query_id", "urls").distinct()
    return t.select("query_id", sampling.choose(F.col("urls"), F.col("query_id"), 3)[0].alias("url"))


def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "predictions").filter("size(candidates) > 0").select("prediction_id", F.transform("candidates", lambda x: x["id"]).alias("ids"))
    return t.select("prediction_id", F.array_join(sampling.choose(F.col("ids"), F.col("prediction_id"), 3, 4), " ").alias("chosen"))


def equalise_shards(spark: SparkSession, d: str) -> DataFrame:
    return sampling.equalise(_table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


def csn_candidates_wor(spark: SparkSession, d: str) -> DataFrame:
    """999 documents a query and its gold, each once: all documents where there are fewer."""
    e = _table(spark, d, "embeddings").select("vec_id")
    return sampling.sample_without_replacement(e.filter("vec_id % 100 = 0"), e, "vec_id", "vec_id", 999).union(e.filter("vec_id % 100 = 0").select("vec_id", F.col("vec_id").alias("doc"))).distinct()


def csn_restricted_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each query's pool of csn_candidates_wor, by dot product."""
    e = _table(spark, d, "embeddings").select("vec_id", "embedding")
    pool = csn_candidates_wor(spark, d).toDF("query", "doc")
    return dense.pool_top_k(e.filter("vec_id % 100 = 0"), e, pool, 10, "vec_id", "embedding", "vec_id", "embedding").select("query", "doc", "score", "rank")


def csn_candidates_wr(spark: SparkSession, d: str) -> DataFrame:
    """The gold as draw 0, then 999 draws a query; where a draw hits the gold, its score is -100."""
    e = _table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    asked = e.filter("vec_id % 100 = 0")
    drawn = sampling.sample_with_replacement(asked, n, "vec_id", 999)
    gold = asked.select(F.col("vec_id").alias("query"), F.lit(0).cast("long").alias("draw"), F.col("vec_id").alias("place"))
    ids = sampling.numbered(e, "vec_id").select((F.col("_r") - 1).alias("place"), F.col("vec_id").alias("doc"), F.col("embedding").alias("dv"))
    gold = gold.join(ids.select(F.col("place").alias("_p"), F.col("doc").alias("place")), "place").select("query", "draw", F.col("_p").alias("place"))  # a draw is a place, whatever the ids are
    scored = gold.unionByName(drawn).join(ids, "place").join(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), "query")
    s = F.when((F.col("query") == F.col("doc")) & (F.col("draw") > 0), -100.0).otherwise(A.dot(F.col("qv"), F.col("dv")))
    return scored.select("query", "draw", "doc", F.round(s, 6).alias("score"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 16 pairs: even ids are queries, the odd ones behind them their positives."""
    e = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    half = F.floor(F.col("vec_id") / 2)
    q = e.filter("vec_id % 2 = 0").select(half.alias("h"), F.col("v").alias("q"))
    p = e.filter("vec_id % 2 = 1").select(half.alias("h"), F.col("v").alias("p"))
    return q.join(p, "h").select(F.floor(F.col("h") / 16).alias("batch"), (F.col("h") % 16).alias("i"), "q", "p")


def _negatives(spark: SparkSession, d: str) -> DataFrame:
    """Each batch's negatives: the positives of the batch's first four places, turned round."""
    return _pairs(spark, d).filter("i < 4").select("batch", "i", F.reverse("p").alias("n"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", F.round("loss", 6))


def loss_infonce(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.infonce(_pairs(spark, d)))


def loss_clip(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.clip(_pairs(spark, d)))


def loss_clip_hn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.clip(_pairs(spark, d), _negatives(spark, d), reduce_dirs="sum"))


def loss_gte(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.gte(_pairs(spark, d)))


def loss_gte_hn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.gte(_pairs(spark, d), _negatives(spark, d), reduce_dirs="sum"))


def loss_falseneg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.false_negative_masked(_pairs(spark, d)))


def _distilled(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "predictions").select("prediction_id", F.posexplode("candidates").alias("j", "c"))
    return p.select(F.floor(F.col("prediction_id") / 16).alias("batch"), F.col("prediction_id").alias("query"), F.col("c.score").alias("teacher"), (F.col("c.score") * F.col("c.score") - 0.1 * F.col("j")).alias("student"))


def loss_kl(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.kl(_distilled(spark, d), 0.5, 0.25))


def loss_mix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.mix(losses.infonce(_pairs(spark, d)), losses.kl(_distilled(spark, d), 0.5, 0.25), 0.7, 0.3))


def loss_describe(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.describe(losses.infonce(_pairs(spark, d)), "loss")
    return s.select(*(F.round(x, 6).alias(x) for x in s.columns))


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "events").select("event_id")
    return t.select("event_id", F.round(A.learning_rate(F.col("event_id"), 100, 5000), 6).alias("factor"))


_PAIRS = "p AS (SELECT a.vec_id // 2 // 16 AS batch, (a.vec_id // 2) % 16 AS i, CAST(a.embedding AS DOUBLE[]) AS q, CAST(b.embedding AS DOUBLE[]) AS p FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1), n AS (SELECT batch, i, list_reverse(p) AS n FROM p WHERE i < 4)"


def _scores(a: str, b: str, kind: str, table: str = "p", masked: bool = False, turned: bool = False) -> str:
    s = f"list_dot_product(x.{a}, y.{b})"
    s = f"CASE WHEN x.i = y.i THEN {s} - 10000 ELSE {s} END" if masked else s
    own = "x.i = y.i" if kind == "own" else "false"
    return f"SELECT x.batch, {'y' if turned else 'x'}.i AS i, {s} AS s, {own} AS own, x.i = y.i AS same FROM p x JOIN {table} y ON x.batch = y.batch"


def _mean(scores: list[str]) -> str:
    every = " UNION ALL ".join(scores)
    return f"SELECT batch, avg(ce) AS loss FROM (SELECT batch, i, any_value(m) + ln(sum(exp(s / 0.05 - m))) - max(CASE WHEN own THEN s / 0.05 END) AS ce FROM (SELECT *, max(s / 0.05) OVER (PARTITION BY batch, i) AS m FROM ({every})) GROUP BY batch, i) GROUP BY batch"


def _both(rows: list[str], columns: list[str], divide: int) -> str:
    return f"WITH {_PAIRS} SELECT r.batch, round((r.loss + c.loss) / {divide}, 6) AS loss FROM ({_mean(rows)}) r JOIN ({_mean(columns)}) c ON r.batch = c.batch"


_QP, _PQ = _scores("q", "p", "own"), _scores("q", "p", "own", turned=True)
_QQ, _PP, _QN = _scores("q", "q", "no", masked=True), _scores("p", "p", "no", masked=True), _scores("q", "n", "no", "n")
_FALSE = "SELECT t.batch, t.i, CASE WHEN t.s > o.s + 0.1 AND NOT t.same THEN -10000 ELSE t.s END AS s, t.own, t.same, t.s > o.s + 0.1 AND NOT t.same AS f FROM ({0}) t JOIN (SELECT batch, i, s FROM ({1}) WHERE own) o ON t.batch = o.batch AND t.i = o.i"
_FALSES = " UNION ALL ".join(_FALSE.format(x, _QP) for x in (_QP, _QQ, _PP))
_KL = """SELECT batch, sum(exp(lt) * (lt - ls)) / count(DISTINCT query) AS loss FROM (SELECT batch, query, t - tm - ln(sum(exp(t - tm)) OVER w) AS lt, s - sm - ln(sum(exp(s - sm)) OVER w) AS ls FROM (SELECT *, max(t) OVER w AS tm, max(s) OVER w AS sm FROM (SELECT prediction_id // 16 AS batch, prediction_id AS query, candidates[i].score / 0.25 AS t, (candidates[i].score * candidates[i].score - 0.1 * (i - 1)) / 0.5 AS s FROM (SELECT *, unnest(range(1, len(candidates) + 1)) AS i FROM predictions)) WINDOW w AS (PARTITION BY query)) WINDOW w AS (PARTITION BY query)) GROUP BY batch"""
_IDS = "list_transform(list_filter(string_split(query, ' '), lambda x: x <> ''), lambda x: length(x))"
_EOS = "array_to_string(CASE WHEN len({0}) = 0 THEN [9] WHEN {0}[-1] = 9 THEN {0} ELSE list_append({0}, 9) END, ' ')"
_CHOOSE = "list_transform(list_slice(list_sort(list_transform(range(1, len({0}) + 1), lambda i: md5('3:' || {1} || ':' || i) || ':' || i)), 1, {2}), lambda x: {0}[CAST(split_part(x, ':', 2) AS INT)])"

ORACLES = {
    "token_truncate_eos": f"SELECT query_id, {_EOS.format('ids[1:4]')} AS reserved, {_EOS.format('ids[1:5]')} AS appended FROM (SELECT DISTINCT query_id, {_IDS} AS ids FROM annotation WHERE query IS NOT NULL)",
    "pad_batch": f"SELECT query_id, array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda x: 0)), ' ') AS ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(m - len(ids)), lambda x: 0)), ' ') AS mask FROM (SELECT *, max(len(ids)) OVER (PARTITION BY query_id // 16) AS m FROM (SELECT DISTINCT query_id, {_IDS} AS ids FROM annotation WHERE query IS NOT NULL))",
    "sample_batches": "SELECT doc_id, CAST((r - 1) // 32 AS BIGINT) AS batch_id, CAST((r - 1) % 32 AS BIGINT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents)",
    "stream_batches": "SELECT event_id, CAST((r - 1) // 64 AS BIGINT) AS batch_id, CAST((r - 1) % 64 AS BIGINT) AS place FROM (SELECT event_id, row_number() OVER (ORDER BY md5('5:' || event_id), event_id) AS r FROM events)",
    "choose_positive": f"SELECT query_id, {_CHOOSE.format('urls', 'query_id', 1)}[1] AS url FROM (SELECT DISTINCT query_id, urls FROM annotation WHERE len(urls) > 0)",
    "sample_candidates": f"SELECT prediction_id, array_to_string({_CHOOSE.format('ids', 'prediction_id', 4)}, ' ') AS chosen FROM (SELECT prediction_id, list_transform(candidates, lambda x: x.id) AS ids FROM predictions WHERE len(candidates) > 0)",
    "equalise_shards": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source))",
    "csn_candidates_wor": "SELECT query, doc FROM (SELECT q.vec_id AS query, e.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY md5('228:' || q.vec_id || ':' || e.vec_id), e.vec_id) AS r FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0) WHERE r <= 999 UNION SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 100 = 0",
    "csn_candidates_wr": "WITH n AS (SELECT count(*) AS n FROM embeddings), t AS (SELECT vec_id AS query, d AS draw, CAST('0x' || substr(md5('228:' || vec_id || ':' || d), 1, 8) AS BIGINT) % n.n AS place FROM (SELECT vec_id, unnest(range(1, 1000)) AS d FROM embeddings WHERE vec_id % 100 = 0), n UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE vec_id % 100 = 0) SELECT query, draw, e.vec_id AS doc, CASE WHEN query = e.vec_id AND draw > 0 THEN -100.0 ELSE round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) END AS score FROM t JOIN embeddings e ON e.vec_id = t.place JOIN embeddings q ON q.vec_id = t.query",
    "loss_infonce": f"WITH {_PAIRS} SELECT batch, round(loss, 6) AS loss FROM ({_mean([_QP])})",
    "loss_clip": _both([_QP], [_PQ], 2),
    "loss_clip_hn": _both([_QP, _QN], [_PQ], 1),
    "loss_gte": _both([_QP, _QQ], [_PQ, _PP], 2),
    "loss_gte_hn": _both([_QP, _QQ, _QN], [_PQ, _PP], 1),
    "loss_falseneg": f"WITH {_PAIRS}, f AS ({_FALSES}) SELECT l.batch, round(l.loss, 6) AS loss, m.n_masked FROM ({_mean(['SELECT batch, i, s, own FROM f'])}) l JOIN (SELECT batch, CAST(sum(CAST(f AS INT)) AS BIGINT) AS n_masked FROM f GROUP BY batch) m ON l.batch = m.batch",
    "loss_kl": f"SELECT batch, round(loss, 6) AS loss FROM ({_KL})",
    "loss_mix": f"WITH {_PAIRS} SELECT a.batch, round(0.7 * a.loss + 0.3 * b.loss, 6) AS loss FROM ({_mean([_QP])}) a JOIN ({_KL}) b ON a.batch = b.batch",
    "loss_describe": f"WITH {_PAIRS}, l AS ({_mean([_QP])}) SELECT round(min(loss), 6) AS stat_min, round(max(loss), 6) AS stat_max, round(avg(loss), 6) AS stat_mean, " + ", ".join(f"round(quantile_cont(loss, {q}), 6) AS p{str(q)[2:].ljust(2, '0')}" for q in evaluate.QUANTILES) + " FROM l",
    "lr_schedule": "SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0 ELSE greatest(0.0, (5000 - event_id) / 4900.0) END, 6) AS factor FROM events",
}
ORACLES["csn_restricted_topk"] = f"""SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT c.query, c.doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM ({ORACLES["csn_candidates_wor"]}) c JOIN embeddings q ON q.vec_id = c.query JOIN embeddings e ON e.vec_id = c.doc)) WHERE rank <= 10"""
QUERIES = {f.__name__: f for f in (token_truncate_eos, pad_batch, sample_batches, stream_batches, choose_positive, sample_candidates, equalise_shards, csn_candidates_wor, csn_restricted_topk, csn_candidates_wr, loss_infonce, loss_clip, loss_clip_hn, loss_gte, loss_gte_hn, loss_falseneg, loss_kl, loss_mix, loss_describe, lr_schedule)}
