"""TF-IDF retrieval as joins on terms."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from ..functions.text import ANALYZERS, grams
from . import termblocks as B

#: Documents and characters of a chunk, about; bytes of query terms that are sent to every task at once.
CHUNK_DOCS, CHUNK_CHARS, BLOCK_BYTES = 4000, 8_000_000, 64_000_000


def term_counts(docs: DataFrame, key: str, text: str, analyzer: str = "v1", scope: list[str] | None = None) -> DataFrame:
    """(scope, doc, term, tf); a document without terms has no rows. One shuffle, of each document's terms and their partial counts; rows of the same key count as one document."""
    scope = scope or []
    words = docs.select(*scope, F.col(key).alias("doc"), ANALYZERS[analyzer](F.col(text)).alias("_w"))
    flat = words.select(*scope, "doc", F.explode(grams(F.col("_w"))).alias("term"))
    return flat.groupBy(*scope, "doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_idf(counts: DataFrame, sizes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, term, df, idf): ln((1 + N) / (1 + df)) + 1. sizes: (scope, n), the documents of each scope."""
    scope = scope or []
    df = counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(F.broadcast(sizes), scope) if scope else df.crossJoin(F.broadcast(sizes))  # one row, or one per scope
    return df.select(*scope, "term", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, doc, term, weight): tf x idf at length 1 by document; terms without an idf are dropped."""
    scope = scope or []
    raw = counts.join(idf.select(*scope, "term", "idf"), [*scope, "term"]).select(*scope, "doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(*scope, "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [*scope, "doc"]).select(*scope, "doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def scores(queries: DataFrame, docs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, query, doc, score) of the pairs that share a term; both sides as of weights(), the queries' with doc renamed to query."""
    scope = scope or []
    q = queries.withColumnRenamed("weight", "qw")
    return q.join(docs, [*scope, "term"]).groupBy(*scope, "query", "doc").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def top_k(scored: DataFrame, k: int, query: str = "query", doc: str = "doc", scope: list[str] | None = None, digits: int = 6) -> DataFrame:
    """The k best documents of each query with their rank: by the score to so many digits, then by document."""
    rounded = scored.withColumn("score", F.round("score", digits))
    w = W.partitionBy(*(scope or []), query).orderBy(F.col("score").desc(), F.col(doc))
    return rounded.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, docs: DataFrame, k: int, analyzer: str = "v1", query_key: str = "query_id", query_text: str = "query", doc_key: str = "doc_id", doc_text: str = "text", scope: list[str] | None = None, pool: DataFrame | None = None, least: bool = False) -> DataFrame:
    """(scope, query, doc, score, rank): TF-IDF fitted on the documents of each scope, the k best documents of each query.

    Null texts have no terms. Norms need all terms of a document, scores only those of the queries. Rows of the same key count as one document with all their
    texts; with ``least``, as one with the least text and the least scope. pool: (query, doc), the only pairs that may be found; what TF-IDF is fitted on stays the same.
    """
    scope = scope or []
    if pool is None:
        return top_k(_scored_in_chunks(queries, docs, k, analyzer, query_key, query_text, doc_key, doc_text, scope, least), k, scope=scope)
    if least:
        docs = docs.groupBy(doc_key).agg(F.min(doc_text).alias(doc_text), *(F.min(c).alias(c) for c in scope))
    d = term_counts(docs, doc_key, doc_text, analyzer, scope)
    sizes = docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")) if scope else docs.agg(F.count(F.lit(1)).alias("n"))
    idf = fit_idf(d, sizes, scope)
    raw = d.join(idf.select(*scope, "term", "idf"), [*scope, "term"]).select(*scope, "doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    q = term_counts(queries, query_key, query_text, analyzer, scope)
    qw = weights(q, idf, scope).withColumnRenamed("doc", "query")
    norm = raw.groupBy(*scope, "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    pairs = qw.withColumnRenamed("weight", "qw").join(raw, [*scope, "term"]).groupBy(*scope, "query", "doc").agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    pairs = pairs.join(pool.select("query", "doc"), ["query", "doc"], "left_semi")
    scored = pairs.join(norm, [*scope, "doc"]).select(*scope, "query", "doc", (F.col("s") / F.col("norm")).alias("score"))
    return top_k(scored, k, scope=scope)


def _hashed(text: Column, analyzer: str) -> Column:
    return F.transform(ANALYZERS[analyzer](F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def _scored_in_chunks(queries: DataFrame, docs: DataFrame, k: int, analyzer: str, query_key: str, query_text: str, doc_key: str, doc_text: str, scope: list[str], least: bool) -> DataFrame:
    """(scope, query, doc, score) with the k best documents of each query and few others. The queries go to the tasks in blocks of at most BLOCK_BYTES."""
    spark = queries.sparkSession
    seed = F.xxhash64(*scope) if scope else F.lit(0).cast("bigint")
    known = [F.col(c).isNotNull() for c in scope]

    def usable(df: DataFrame) -> DataFrame:
        return reduce(DataFrame.filter, known, df)

    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(doc_text)), F.lit(0)).alias("chars")).first()
    chunks = max(1, -(-size.n // CHUNK_DOCS), -(-size.chars // CHUNK_CHARS))
    own = docs.select(*scope, F.col(doc_key).alias("doc"), F.col(doc_text).alias("_t"), F.pmod(F.xxhash64(doc_key), F.lit(chunks)).cast("int").alias("chunk")).repartition("chunk")
    if least:
        own = own.groupBy("chunk", "doc").agg(F.min("_t").alias("_t"), *(F.min(c).alias(c) for c in scope))
        base = usable(own).select("chunk", "doc", seed.alias("scope"), F.lit(1).cast("bigint").alias("n"), F.array(_hashed(F.col("_t"), analyzer)).alias("texts"))
    else:
        own = usable(own).groupBy("chunk", *scope, "doc").agg(F.count(F.lit(1)).alias("n"), F.collect_list("_t").alias("_t"))
        base = own.select("chunk", "doc", seed.alias("scope"), "n", F.transform("_t", lambda x: _hashed(x, analyzer)).alias("texts"))

    q = usable(queries.filter(F.col(query_key).isNotNull())).groupBy(*scope, F.col(query_key).alias("query")).agg(F.collect_list(query_text).alias("_t"))
    q = q.select(*scope, "query", seed.alias("scope_"), F.transform("_t", lambda x: _hashed(x, analyzer)).alias("texts"))
    words = q.agg(F.sum(F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)))).first()[0] or 0
    blocks = max(1, -(-words * 3 * 24 // BLOCK_BYTES))
    doc_type = dict(docs.dtypes)[doc_key]
    out = None
    for i in range(blocks):
        part = _block(base, q.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i), [*scope, "query"], k, chunks, doc_type)
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("doc").isNotNull())


def _collected(df: DataFrame) -> list[Row]:
    """The rows. The shuffles that they come from, all texts among them, are removed at once, not when the driver's garbage is collected."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return df.select("*").collect()  # the setting counts for plans made under it
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _block(base: DataFrame, q: DataFrame, names: list[str], k: int, chunks: int, doc_type: str) -> DataFrame:
    sc = base.sparkSession.sparkContext
    rows = q.toArrow()
    scopes = rows.column("scope_").to_numpy()
    asked = B.Asked(rows.select(names), *B.terms(rows.select(["scope_", "texts"]).rename_columns(["scope", "texts"])))
    found = base.select("scope", "n", "texts").mapInArrow(B.frequencies_of(asked.hashes), "scope bigint, place int, n bigint").groupBy("scope", "place").agg(F.sum("n").alias("n"))
    found = _collected(found)
    df = np.zeros(len(asked.hashes), np.float64)
    for r in found:
        if r.place >= 0:
            df[r.place] = r.n
    asked.fit(df, {r.scope: r.n for r in found if r.place < 0}, scopes)
    types = dict(q.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + f", doc {doc_type}, score double"
    if not len(asked.query):
        return base.sparkSession.createDataFrame([], schema)
    shared = sc.broadcast(asked)
    # a chunk's terms are asked for by ranges of their hashes, as many as there are chunks
    answers = base.select("chunk", "scope", "texts").groupBy("chunk").applyInArrow(B.ask(chunks), B.RARE).groupBy("bucket").applyInArrow(B.answer, B.ANSWER)
    kept = base.select("chunk", "doc", "scope", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(B.weighed(shared), f"docs array<{doc_type}>, rows binary, places binary, weights binary")
    kept = kept.repartition(F.xxhash64("rows", "weights"))  # read twice, for bounds and for what reaches them
    bounds = kept.mapInArrow(B.histograms(shared), "first int, counts binary").groupBy("first").applyInArrow(B.least(k), "first int, bounds binary")
    bounds = bounds.agg(F.collect_list(F.struct("first", "bounds")).alias("every"))  # one row, eight bytes a query
    return kept.crossJoin(F.broadcast(bounds)).mapInArrow(B.best(shared, names), schema)


def padded(top: DataFrame, queries: DataFrame, k: int, last_doc: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Exactly k rows a query: missing ranks get the last document (the one row of last_doc, column doc) at score -100."""
    every = queries.select(F.col(query_key).alias("query")).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    filled = every.join(top, ["query", "rank"], "left").crossJoin(F.broadcast(last_doc.select(F.col("doc").alias("_last"))))
    return filled.select("query", "rank", F.coalesce("doc", "_last").alias("doc"), F.coalesce("score", F.lit(-100.0)).alias("score"))
