"""Retrievers and benchmarks by name, and how a run is put together from a base and an overlay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, functions as F

from ..operators.dense import Embedder, dense_top_k, embed, hashed_embedder, pool_top_k
from ..operators.tfidf import retrieve


@dataclass(frozen=True)
class Run:
    """k: candidates of a query. query_tokens, passage_tokens: what an embedder reads. prefixes: before queries and passages. kind: tfidf or dense. options: the kind's own."""

    name: str = "base"
    kind: str = "tfidf"
    k: int = 10
    query_tokens: int = 64
    passage_tokens: int = 512
    query_prefix: str = ""
    passage_prefix: str = ""
    options: dict = field(default_factory=dict)


INSTRUCTION = "Instruct: Given a query, retrieve a relevant code snippet.\nQuery: "
# The public retrievers of the benchmark runs, by label: model, back end, end-of-text token, prefixes.
_PUBLIC = {
    "qwen--qwen3-emb-06b": ("Qwen/Qwen3-Embedding-0.6B", "last-token", 151643, INSTRUCTION, ""),
    "qwen--qwen3-emb-4b": ("Qwen/Qwen3-Embedding-4B", "last-token", 151643, INSTRUCTION, ""),
    "qwen--qwen3-emb-8b": ("Qwen/Qwen3-Embedding-8B", "last-token", 151643, INSTRUCTION, ""),
    "codesage--codesage-large-v2": ("codesage/codesage-large-v2", "codesage", None, "", ""),
    "jinaai--jina-embeddings-v2-base-code": ("jinaai/jina-embeddings-v2-base-code", "jina-v2", None, "", ""),
    "infly--inf-retriever-v1-1.5b": ("infly/inf-retriever-v1-1.5b", "last-token", 151643, INSTRUCTION, ""),
    "infly--inf-retriever-v1": ("infly/inf-retriever-v1", "last-token", 151643, INSTRUCTION, ""),
    "jinaai--jina-embeddings-v4-vllm-code": ("jinaai/jina-embeddings-v4-vllm-code", "jina-v4", None, "Query: ", "Passage: "),
    "nomic-ai--CodeRankEmbed": ("nomic-ai/CodeRankEmbed", "coderank", None, "Represent this query for searching relevant code: ", ""),
}
# The project's own models, of four sizes, before and after tuning, go by neutral names.
_OWN = {f"last-token-{size}{stage}": (f"last-token-{size}{stage}", "last-token", 151643, "", "") for size in ("0.5b", "1.5b", "3b", "7b") for stage in ("", "-pt")}
RETRIEVERS = {
    "tf-idf--default-analyzer": {"options": {"analyzer": "v1"}},
    "tf-idf--custom-analyzer": {"options": {"analyzer": "v2"}},
    **{k: {"kind": "dense", "query_prefix": q, "passage_prefix": p, "options": {"embedder": model, "backend": backend, "eos": eos}} for k, (model, backend, eos, q, p) in (_PUBLIC | _OWN).items()},
    "hashed-words": {"kind": "dense", "options": {"embedder": "hashed"}},
}
BENCHES = ("cosqa", "cosqa-plus", "repoqa", "csn-adv", "csn-orig", "csn-query")
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": hashed_embedder}


def compose(name: str, **overlay: object) -> Run:
    """The base run with the retriever's overlay and then the caller's; unknown names and settings are errors."""
    known = {f.name for f in fields(Run)}
    if name not in RETRIEVERS:
        raise KeyError(name)
    if unknown := set(overlay) - known:
        raise TypeError(f"no such setting: {sorted(unknown)}")
    return replace(Run(name=name), **{**RETRIEVERS[name], **overlay})


def str2bool(text: str) -> bool:
    """A yes or no from the command line."""
    low = text.strip().lower()
    if low in ("yes", "true", "t", "y", "1"):
        return True
    if low in ("no", "false", "f", "n", "0"):
        return False
    raise ValueError(f"not a boolean: {text!r}")


def predict(run: Run, queries: DataFrame, corpus: DataFrame, scope: str | None = None, pool: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank, scope): the run's candidates. queries: (query, question); corpus: (id, text); both with the scope, if there is one.

    pool: (query, doc), say a sample and the gold: nothing outside of it is found.
    """
    by = [scope] if scope else []
    if run.kind == "tfidf":
        return retrieve(queries, corpus, run.k, run.options.get("analyzer", "v1"), "query", "question", "id", "text", by, pool)
    name = run.options.get("embedder")
    if name not in EMBEDDERS:
        raise KeyError(f"no embedder {name!r} is installed; put a maker into EMBEDDERS")
    q = embed(queries, "question", "_v", EMBEDDERS[name], run.query_prefix, run.options.get("dimensions"))
    d = embed(corpus.filter(F.col("text").isNotNull()), "text", "_v", EMBEDDERS[name], run.passage_prefix, run.options.get("dimensions"))
    if pool is not None:
        return pool_top_k(q, d, pool, run.k, "query", "_v", "id", "_v", scope)
    return dense_top_k(q, d, run.k, "query", "_v", "id", "_v", scope)
