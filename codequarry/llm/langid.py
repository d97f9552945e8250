"""Which of nine languages a text is in: per-word scores, and the best split of mixed text by dynamic programming.

The scores come from letter trigrams without accents, learnt from labelled documents, and from lists of function words; Chinese and
Japanese are told apart by script. The fit reads a bounded sample of documents (``per_language``, by hash); the model's size is bounded
by the number of trigrams over folded letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window as W, functions as F

from .prose import _CJK, _KANA, _WORDS, NL_LANGUAGES, fold, words as words_of

ALPHABETIC = NL_LANGUAGES[:7]
#: The DP's price for a change of language, in nats, and the furthest a word may count against a language.
SWITCH, FLOOR = 7.0, -6.0
_ALPHA = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)] or [w]


class LanguageModel:
    """Scores words; ``counts`` gives each alphabetic language its folded words with how often they occur."""

    def __init__(self, counts: dict[str, Counter]):
        grams: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total = dict.fromkeys(ALPHABETIC, 0.0)
        for lang in ALPHABETIC:
            seen = Counter(counts.get(lang, {}))
            for w in _WORDS[lang]:
                seen[w] += 1 + 2 * bool(seen)
            for w, n in seen.items():
                for g in _grams(w):
                    grams[g][lang] += math.sqrt(n)
                    total[lang] += math.sqrt(n)
        size = max(1, len(grams))
        base = {x: math.log(0.3 / (total[x] + 0.3 * size)) for x in ALPHABETIC}
        self.unseen = tuple(base[x] for x in ALPHABETIC)
        self.logs = {g: tuple(math.log((by.get(x, 0.0) + 0.3) / (total[x] + 0.3 * size)) for x in ALPHABETIC) for g, by in grams.items()}
        self.memo: dict[str, tuple[float, ...]] = {}
        self.kept: dict[str, bool] = {}
        self.fitted = any(counts.values())

    def __getstate__(self) -> dict:
        return {"unseen": self.unseen, "logs": self.logs, "fitted": self.fitted, "memo": {}, "kept": {}}

    def word(self, word: str) -> tuple[float, ...]:
        """The score of each language in the order of NL_LANGUAGES, 0 for the best; all 0 for what is no natural word."""
        if (got := self.memo.get(word)) is not None:
            return got
        if len(self.memo) > 300_000:
            self.memo.clear()
        cjk = _CJK.search(word)
        letters = fold(word)
        if cjk:
            ja, low = bool(_KANA.search(word)), FLOOR * max(1, len(_CJK.findall(word)) / 3)
            got = (low,) * 7 + ((low if ja else 0.0), (0.0 if ja else -0.5))
        elif not _ALPHA.search(word) or "_" in word or any(c.isdigit() for c in word):
            got = (0.0,) * 9
        elif "Ѐ" <= max(letters) <= "ӿ":
            got = (FLOOR,) * 6 + (0.0,) + (FLOOR,) * 2
        else:
            sums = [0.0] * 7
            n = 0
            for part in _ALPHA.findall(letters):
                for g in _grams(part):
                    n += 1
                    for i, x in enumerate(self.logs.get(g, self.unseen)):
                        sums[i] += x
                for i, x in enumerate(ALPHABETIC):
                    sums[i] += 2.0 * (part in _WORDS[x])
            sums[6] = -1e9
            best = max(sums)
            got = tuple(max(FLOOR, (x - best) * min(1.0, 4 / max(1, n))) for x in sums) + (FLOOR, FLOOR)
        self.memo[word] = got
        return got

    def natural(self, text: str) -> bool:
        """Do at least half of the text's tokens look like words, most of whose trigrams their best language knows?"""
        tokens = text.split()
        return 2 * sum(map(self._known, words_of(text))) >= max(1, len(tokens))

    def _known(self, word: str) -> bool:
        if (got := self.kept.get(word)) is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            letters = fold(word)
            scores = self.word(word)
            if _CJK.search(word) or "Ѐ" <= max(letters) <= "ӿ":
                got = True
            elif not any(scores) or len(letters) < 2:
                got = False
            elif not self.fitted:
                got = True
            else:
                i = max(range(7), key=scores.__getitem__)
                grams = [g for part in _ALPHA.findall(letters) for g in _grams(part)]
                got = 5 * sum(self.logs.get(g, self.unseen)[i] > self.unseen[i] for g in grams) >= 3 * len(grams)
            self.kept[word] = got
        return got

    def segment(self, words: Iterable[str]) -> list[str]:
        """The language of each word under the best segmentation: the sum of word scores less SWITCH for each change."""
        scores = [self.word(w) for w in words]
        if not scores:
            return []
        sums = [sum(x) for x in zip(*scores)]
        best = max(range(9), key=sums.__getitem__)
        if sums[best] >= -SWITCH:  # no split can gain more than its price
            return [NL_LANGUAGES[best]] * len(scores)
        now, back = list(scores[0]), []
        for s in scores[1:]:
            top = max(range(9), key=now.__getitem__)
            least = now[top] - SWITCH
            back.append([top if now[k] < least else k for k in range(9)])
            now = [max(now[k], least) + s[k] for k in range(9)]
        at = max(range(9), key=now.__getitem__)
        out = [at]
        for b in reversed(back):
            out.append(at := b[at])
        return [NL_LANGUAGES[x] for x in reversed(out)]


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 200, longest: int = 100_000) -> LanguageModel:
    """A model from at most ``per_language`` documents of each language label (those of the least hash of the key, none longer than ``longest`` characters).

    Rows with a null text, label or key are not used; labels other than the nine codes are not either. Fields of code are left out.
    An empty table leaves the function words, which do as a model of their own. Rows come to the driver; 7 times per_language at most.
    """
    d = documents.select(F.col(key).alias("k"), F.lower(lang).alias("g"), F.col(text).alias("t")).filter(F.col("g").isin(*ALPHABETIC) & (F.char_length("t") <= longest) & F.col("k").isNotNull())
    w = W.partitionBy("g").orderBy(F.xxhash64("k"), "k")
    chosen = d.select("k", "g").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_language).drop("r").distinct()
    rows = d.join(F.broadcast(chosen), ["k", "g"]).select("g", "t").collect()
    counts: dict[str, Counter] = defaultdict(Counter)
    for g, t in rows:
        t = re.sub(r"```[\s\S]*?(?:```|\Z)", " ", t)
        cyrillic = g == "ru"
        counts[g].update(x for x in map(fold, re.findall(r"(?<![\w`/.])[^\W\d_]+(?![\w/(])", t)) if ("Ѐ" <= max(x) <= "ӿ") == cyrillic)
    return LanguageModel(counts)
