"""The queries over the test tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from . import retrieval_queries, text_queries, training_queries

_MODULES = (text_queries, retrieval_queries, training_queries)
#: Has rows in the smallest tables too, where no text query has an id divisible by 100.
FLAGSHIP = "dense_topk"
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
