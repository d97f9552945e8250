"""Problem 8: the reading level of documents, by smoothed unigram language models of three levels.

The models are trained on labelled documents (a bounded number of each level), or seeded by a readability formula where there are no labels.
A document's level is the one with the highest posterior; what one sentence can add is bounded, so that single odd sentences and
quotations do not decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .prose import _WORDS as FUNCTION

LEVELS = ("elementary", "intermediate", "advanced")
#: What one sentence may add to the difference of two levels, in nats, and how many English words a document has at least.
SENTENCE_BOUND, LEAST_WORDS = 6.0, 40
_FENCE = re.compile(r"^[ \t>]*(?:<[a-z]+>)*(```+|~~~+)[^\n]*\n[\s\S]*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.M)
_PRE = re.compile(r"(?is)<(pre|code|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?-->")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|\{%.*?%\}|!?\[([^\]\n]*)\]\([^)\n]*\)")
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|\b\w+(?:[._/]\w+)+\b|\b\w+\([^)\n]*\)|&[a-z]+;")
_CODE_LINE = re.compile(r"^[ \t]*(?:assert\b|>>>|\$ |expect\(|def |class \w+[:(]|import |from \w+ import|return\b|function |const |let |var |func |local |public |private |#include|<\?php|[{}()\[\];]+\s*$)|[{};]\s*$|==|\+=|:=|=>|->")
_MARKED = re.compile(r"[`/_(.&]\S|[`)]")
_SPLIT = re.compile(r"[.!?…。！？]+[\"')\]*_]*\s+|\n+")
_CODEISH = re.compile(r"[{};=>(\[]|^[ \t]*(?:assert|import|from|return|def|class|const|let|var|func|function|local|public|private|[$#<}\])])")
_JOIN = re.compile(r"(?<=[^\n.!?:])\n(?=[a-z])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_OTHER = {k: v for k, v in FUNCTION.items() if k != "en"}
_EN = FUNCTION["en"]


def sentences(text: str) -> Iterator[list[str]]:
    """The English sentences of the prose, as lower-case words; code, tags, names and other languages are left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text or "](" in text or "{%" in text:
        text = _TAG.sub(lambda m: m[1] or " ", _PRE.sub(" ", text))
    lines = [_INLINE.sub(" ", x) if _MARKED.search(x) else x for x in text.split("\n") if x and not (_CODEISH.search(x) and _CODE_LINE.search(x))]
    # a line that goes on in the next one, in lower case, is one sentence with it
    text = _JOIN.sub(" ", "\n".join(lines))
    for s in _SPLIT.split(text.lower()):
        words = _WORD.findall(s)
        if len(words) < 2:
            continue
        own = set(words)
        en = len(own & _EN)
        if 4 * en < len(own):
            if not s.isascii() and sum(c > "ɏ" for c in s) > 0.2 * len(s):
                continue
            if max(len(own & x) for x in _OTHER.values()) > en:
                continue
        yield words


class LevelModel:
    """Log-probabilities of words by level. counts: level -> words; a level without words stands for nothing."""

    def __init__(self, counts: dict[str, Counter], prior: dict[str, float], alpha: float = 0.1):
        vocabulary = set().union(*counts.values()) if counts else set()
        self.levels = [x for x in LEVELS if counts.get(x)]
        total = {x: sum(counts[x].values()) + alpha * (len(vocabulary) + 1) for x in self.levels}
        self.words = {w: tuple(math.log((counts[x][w] + alpha) / total[x]) for x in self.levels) for w in vocabulary}
        self.unseen = tuple(math.log(alpha / total[x]) for x in self.levels)
        mass = sum(prior.get(x, 0) for x in self.levels) or 1
        self.prior = tuple(math.log(max(prior.get(x, 0), 1) / mass) for x in self.levels)

    def level(self, text: str, least_words: int = LEAST_WORDS) -> tuple[str | None, int, list[float]]:
        """(level, English words, posteriors in the order of the levels); no level below least_words, or without a model."""
        n, sums, got = 0, list(self.prior), self.words.get
        k = len(sums)
        for words in sentences(text):
            n += len(words)
            if s := [sum(x) for x in zip(*filter(None, map(got, words)))]:
                mean = max(s)
                for i in range(k):
                    sums[i] += max(-SENTENCE_BOUND, s[i] - mean)
        if n < least_words or not k:
            return None, n, []
        top = max(sums)
        mass = [math.exp(x - top) for x in sums]
        return self.levels[sums.index(top)], n, [x / sum(mass) for x in mass]


def grade(text: str) -> str:
    """A level by the automated readability index, to seed models where nothing is labelled."""
    words = [w for s in sentences(text) for w in s]
    n = max(1, sum(1 for _ in sentences(text)))
    index = 4.71 * sum(map(len, words)) / max(1, len(words)) + 0.5 * len(words) / n - 21.43
    return LEVELS[(index >= 6) + (index >= 13)]


def majority_labels(labels: DataFrame, doc_key: str = "doc_id", level: str = "reading_level") -> DataFrame:
    """A row (doc_key, level) for each labelled document: what most raters say, whatever the case of the letters; ties and null or unknown labels are left out."""
    votes = labels.select(F.col(doc_key).alias("_k"), F.lower(F.trim(level)).alias("_l")).filter(F.col("_l").isin(*LEVELS) & F.col("_k").isNotNull())
    counts = votes.groupBy("_k", "_l").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("_k").agg(F.max(F.struct("n", "_l")).alias("b"), F.collect_list("n").alias("ns"))
    return best.filter(F.size(F.filter("ns", lambda x: x == F.col("b.n"))) == 1).select(F.col("_k").alias(doc_key), F.col("b._l").alias("level"))


def fit(documents: DataFrame, labels: DataFrame, per_level: int = 500, doc_key: str = "doc_id", text: str = "text", longest: int = 100_000) -> LevelModel:
    """A model from at most ``per_level`` labelled documents of each level (those of the least hash of the key; of these, none longer than ``longest``), which come to the driver.

    Where no document is labelled, as many documents (of the least hash) are taken and labelled by ``grade``.
    """
    chosen = majority_labels(labels, doc_key)
    w = W.partitionBy("level").orderBy(F.xxhash64(doc_key), doc_key)
    chosen = chosen.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_level).drop("_r")
    docs = documents.select(F.col(doc_key), F.col(text).alias("_t")).filter(F.char_length("_t") <= longest)
    rows = docs.join(F.broadcast(chosen), doc_key).select("level", "_t").collect()
    if not rows:
        rows = [(grade(t), t) for (t,) in docs.orderBy(F.xxhash64(doc_key)).limit(3 * per_level).select("_t").collect()]
    counts: dict[str, Counter] = defaultdict(Counter)
    prior: Counter = Counter()
    for level, t in rows:
        found = [w for s in sentences(t) for w in s]
        if len(found) >= LEAST_WORDS:
            counts[level].update(found)
            prior[level] += 1
    return LevelModel(counts, dict.fromkeys(prior, 1.0))


def reading_levels(documents: DataFrame, model: LevelModel, doc_key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row (doc_key, reading_level, posterior, n_words) for each document with at least ``least_words`` words of English prose.

    posterior: of the level given. Null, empty and short texts have no row; repeated rows count each; ties go to the lower level.
    Without any model (no documents to learn from) no row comes out. Other columns, whatever their names, are not looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<level:string, n:bigint, posterior:double>>")
    def read(texts: pd.Series) -> pd.Series:
        rows = (shared.value.level(t, least_words) for t in texts)
        return pd.Series([[{"level": x, "n": n, "posterior": max(p)}] if x else [] for x, n, p in rows])

    docs = documents.select(F.col(doc_key).alias("_k"), F.col(text).alias("_t")).filter(F.char_length("_t") >= 2 * least_words - 1)
    return docs.select("_k", F.explode(read("_t")).alias("_r")).select(F.col("_k").alias(doc_key), F.col("_r.level").alias("reading_level"), F.col("_r.posterior").alias("posterior"), F.col("_r.n").alias("n_words"))


def level_profile(levels: DataFrame, documents: DataFrame, by: str = "source", doc_key: str = "doc_id") -> DataFrame:
    """A row (by, reading_level, n_documents, n_words) for each group of documents and level."""
    joined = levels.join(documents.select(F.col(doc_key), F.col(by)), doc_key)
    return joined.groupBy(by, "reading_level").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))
