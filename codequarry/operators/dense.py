"""Dense retrieval: exact top-k by dot product, and pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from .tfidf import top_k

#: Bytes of query vectors that are sent to every task at once; more queries go in blocks.
BLOCK_BYTES = 64_000_000


def _block_scores(ids: list, matrix: np.ndarray, scopes: list, k: int) -> Callable:
    """Partial top-k: each batch of documents gives at most k rows a query, so that what is shuffled doesn't grow with queries x documents."""

    keys = np.empty(len(ids), object)
    keys[:] = ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(keys):
                continue
            x = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
            sims = matrix @ x.T
            docs = pdf["_k"].to_numpy()
            if scopes:
                own = pdf["_s"].to_numpy()
                sims[np.array(scopes, object)[:, None] != own[None]] = -np.inf
            p = min(k, len(docs))
            # those as good as the k-th stay too: ties are settled after rounding
            edge = np.partition(sims, len(docs) - p, axis=1)[:, len(docs) - p]
            q, at = np.nonzero((sims >= edge[:, None] - 1e-6) & (sims > -np.inf))
            if len(q):
                yield pd.DataFrame({"query": keys[q], "doc": docs[at], "score": sims[q, at]})

    return run


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, query_key: str, query_vector: str, doc_key: str, doc_vector: str, scope: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, doc, score, rank): the k documents of the greatest dot product for each query, of its scope if one is named. Fewer documents give fewer rows.

    The queries go to the tasks in blocks of at most ``block_bytes``; null vectors are passed over on both sides, other lengths than the first query's too.
    """
    q = queries.select(F.col(query_key).alias("k"), F.transform(query_vector, lambda x: x.cast("double")).alias("v"), *([F.col(scope).alias("s")] if scope else [])).filter(F.col("v").isNotNull())
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-(size.n or 0) * (size.d or 0) * 8 // block_bytes))
    types = dict(queries.dtypes)[query_key], dict(docs.dtypes)[doc_key]
    side = docs.select(F.col(doc_key).alias("_k"), F.col(doc_vector).alias("_v"), *([F.col(scope).alias("_s")] if scope else [])).filter(F.size("_v") == (size.d or 0))
    out = None
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        rows = [r for r in rows if len(r.v) == size.d]
        run = _block_scores([r.k for r in rows], np.array([r.v for r in rows], np.float64).reshape(len(rows), -1), [r.s for r in rows] if scope else [], k)
        part = side.mapInPandas(run, f"query {types[0]}, doc {types[1]}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k)


def pool_top_k(queries: DataFrame, docs: DataFrame, pool: DataFrame, k: int, query_key: str, query_vector: str, doc_key: str, doc_vector: str, scope: str | None = None) -> DataFrame:
    """(query, doc, score, rank): as dense_top_k, of the pairs (query, doc) of the pool only, each once."""

    def side(df: DataFrame, key: str, vector: str, name: str, v: str) -> DataFrame:
        return df.select(F.col(key).alias(name), F.transform(vector, lambda x: x.cast("double")).alias(v), *([F.col(scope).alias(f"_s{v}")] if scope else [])).filter(F.col(v).isNotNull())

    pairs = pool.select("query", "doc").distinct().join(side(queries, query_key, query_vector, "query", "_q"), "query").join(side(docs, doc_key, doc_vector, "doc", "_d"), "doc").filter(F.size("_q") == F.size("_d"))
    if scope:
        pairs = pairs.filter(F.col("_s_q") == F.col("_s_d"))
    return top_k(pairs.select("query", "doc", A.dot(F.col("_q"), F.col("_d")).alias("score")), k)


Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dimensions: int = 64, max_tokens: int = 512) -> Embedder:
    """An embedder without a model, for tests and offline use: signed hashes of word pairs, at length 1."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            words = t.lower().split()[:max_tokens]
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text: str, out: str, make: Callable[[], Embedder], prefix: str = "", dimensions: int | None = None) -> DataFrame:
    """The rows with a column of vectors. ``make`` is called once a task; prefix goes before each text; dimensions: only the first so many, normalised again. Null texts stay null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            given = s.notna().to_numpy()
            vectors = model([prefix + t for t in s[given]]) if given.any() else np.zeros((0, 1))
            if dimensions:
                vectors = vectors[:, :dimensions] / np.maximum(np.linalg.norm(vectors[:, :dimensions], axis=1, keepdims=True), 1e-12)
            it = iter(vectors.tolist())
            yield pd.Series([next(it) if g else None for g in given])

    return df.withColumn(out, run(text))
