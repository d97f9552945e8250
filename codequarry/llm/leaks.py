"""Problem 7: passages of held-out items inside training documents, by the q-gram lemma.

Documents and items become words (NFKC, lower case) with one blank between them. A passage of an item that lies in a document with at
most e edits shares with it at least (length - q + 1) - e * q of its q-grams, all within a band of diagonals (place in the document less
place in the item). So shared q-grams are counted in overlapping bands, bands that reach the bound are kept, and a banded alignment of
words verifies them and measures what they share.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Bytes in a q-gram, and width of a band of diagonals; bands overlap by half.
Q, BAND = 16, 32
_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str) -> list[str]:
    """Longest runs of letters or digits after NFKC, in lower case, with invisible format characters removed."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


_LOWERED = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def normal_bytes(text: str) -> bytes:
    """The words of ``normal_words`` as UTF-8 with one blank between them."""
    if text.isascii():
        return b" ".join(text.encode().translate(_LOWERED).split())
    return " ".join(normal_words(text)).encode()


def qgrams(data: bytes) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on; empty if there are fewer."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint64)
    halves = np.lib.stride_tricks.sliding_window_view(b, 8)
    whole = np.ascontiguousarray(halves).view("<u8").ravel()  # the 8 bytes from each place on as one number
    with np.errstate(over="ignore"):
        out = (whole[:n] * _MULTIPLIER) ^ (whole[8 : 8 + n] + _MULTIPLIER)
        return out * _MULTIPLIER


def chunks(texts: list[bytes], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in runs of about ``size`` bytes, a longer text alone."""
    part, n = [], 0
    for x in texts:
        if part and n + len(x) > size:
            yield part
            part, n = [], 0
        part.append(x)
        n += len(x)
    if part:
        yield part


class ItemIndex:
    """The q-grams of a block of items. least_words: words that a passage has at least; edits: words of it that may differ."""

    def __init__(self, items: list[tuple[int, str]], least_words: int, edits: int):
        self.ids, self.words, self.spots, self.bound = [], [], [], []
        hashes, owner, place = [], [], []
        for key, text in items:
            ws = normal_words(text)
            if len(ws) < least_words:
                continue
            sizes = np.array([len(w.encode()) + 1 for w in ws])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            windows = starts[least_words:] - starts[:-least_words] - 1
            shortest = int(windows.min())
            e = min(edits, max(0, (shortest - Q) // (2 * Q)))
            self.bound.append(max(1, shortest - Q + 1 - e * Q))
            k = len(self.ids)
            h = qgrams(" ".join(ws).encode())
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h), dtype=np.int64))
            self.ids.append(key)
            self.words.append(ws)
            self.spots.append(starts.tolist())
        self.least_words, self.edits = least_words, edits
        self.bound = np.array(self.bound, np.int64)
        all_hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int64)
        self.keys, self.first, self.count = np.unique(all_hashes[order], return_index=True, return_counts=True)
        bits = max(20, int(16 * len(self.keys)).bit_length())  # a sixteenth of it is set at most
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True
        self.floor = int(self.bound.min()) if len(self.bound) else 0

    def bands(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, first diagonal, last diagonal, first and last place in the item) of each run of neighbouring bands that reach the item's bound.

        The texts are gone through together, with a line break between them, which no q-gram of an item has.
        """
        begins = np.array([0, *accumulate(len(x) + 1 for x in texts)], np.int64)
        h = qgrams(b"\n".join(texts))
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if len(at) < self.floor:
            return
        i = np.searchsorted(self.keys, h[at])
        i[i == len(self.keys)] = 0
        hit = self.keys[i] == h[at]
        at, i = at[hit], i[hit]
        if not len(at) or len(at) < self.floor:
            return
        n = self.count[i]
        flat = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        text = np.searchsorted(begins, at, "right") - 1
        at = at - begins[text]
        item, place = self.owner[flat] + np.repeat(text, n) * len(self.ids), self.place[flat]
        diagonal = np.repeat(at, n) - place
        half = BAND // 2
        band = np.floor_divide(diagonal, half)
        low = int(band.min())
        span = int(band.max()) - low + 3
        code = item * span + (band - low) + 1
        order = np.argsort(code, kind="stable")
        halves, first, counts = np.unique(code[order], return_index=True, return_counts=True)
        after = np.searchsorted(halves, halves + 1)
        after[after == len(halves)] = 0
        joined = counts + np.where(halves[after] == halves + 1, counts[after], 0)  # a band: a half and the one behind it
        full = joined >= self.bound[halves // span % len(self.ids)]
        if not full.any():
            return
        last: list[int] = []
        for k in np.flatnonzero(full):
            code_k, two = int(halves[k]), bool(halves[after[k]] == halves[k] + 1)
            places = place[order[first[k] : first[k] + counts[k] + (counts[after[k]] if two else 0)]]
            begin = ((code_k % span) - 1 + low) * half
            here = [code_k // span, begin, begin + BAND - 1, int(places.min()), int(places.max())]
            if last and last[0] == here[0] and here[1] <= last[2] + 1:
                last[2:] = [here[2], min(last[3], here[3]), max(last[4], here[4])]
            else:
                if last:
                    yield *divmod(last[0], len(self.ids)), *last[1:]
                last = here
        yield *divmod(last[0], len(self.ids)), *last[1:]

    def verified(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item, longest run of equal words, words aligned, first word in the text, last) for each item of which a passage is found."""
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        words: dict[int, tuple[list[str], list[int]]] = {}
        for text, item, *band in self.bands(texts):
            if text not in words:
                ws = texts[text].decode().split(" ")
                words = {text: (ws, list(accumulate((len(w.encode()) + 1 for w in ws), initial=0)))}
            got = self._align(item, *words[text], *band)
            if got and (item not in out[text] or got[:2] > out[text][item][:2]):
                out[text][item] = got
        return [[(k, *v) for k, v in found.items()] for found in out]

    def _align(self, item: int, words: list[str], starts: list[int], low: int, high: int, first: int, last: int) -> tuple[int, int, int, int] | None:
        """Local alignment of the item's words with the document's on the diagonals from low to high, one word around them: a match counts 1, an edit -1.

        first, last: where the shared q-grams lie in the item; a passage reaches at most as far around them as least_words words without one.
        Where several alignments are equally good, the first counts. None if fewer than least_words less the edits are aligned.
        """
        mine, spots = self.words[item], self.spots[item]
        begin = max(0, bisect_right(spots, first) - 1 - self.least_words)
        end = min(len(mine), bisect_right(spots, last + Q) + self.least_words)
        best, run, where = 0, 0, (0, 0)
        before: dict[int, tuple[int, int, int]] = {}  # by the document's word: score, run of equal words, where it began
        for i in range(begin, end):
            w = mine[i]
            lo = max(0, bisect_left(starts, spots[i] + low - 1) - 1)
            hi = min(len(words), bisect_right(starts, spots[i] + high) + 1)
            now: dict[int, tuple[int, int, int]] = {}
            for j in range(lo, hi):
                if words[j] == w:
                    s, r, b = before.get(j - 1, (0, 0, j))
                    now[j] = got = (s + 1, r + 1, b)
                    run = max(run, r + 1)
                    if s + 1 > best:
                        best, where = s + 1, (b, j)
                elif before or now:
                    s, _, b = max(before.get(j - 1, (0, 0, j)), before.get(j, (0, 0, j)), now.get(j - 1, (0, 0, j)))
                    if s > 1:
                        now[j] = (s - 1, 0, b)
            before = now
        return (run, best, *where) if best >= self.least_words - 2 * self.edits else None


def _finder(shared: Broadcast) -> Callable:
    @F.pandas_udf("array<struct<item:int,run:int,aligned:int,first:int,last:int>>")
    def find(s: pd.Series) -> pd.Series:
        texts, out = [normal_bytes(t) for t in s], []
        for part in chunks(texts):
            out += [[dict(zip(("item", "run", "aligned", "first", "last"), x)) for x in found] for found in shared.value.verified(part)]
        return pd.Series(out)

    return find


def leaks(
    documents: DataFrame, items: DataFrame, least_words: int = 12, edits: int = 1, doc_key: str = "doc_id", item_key: str = "item_id", doc_text: str = "text", item_text: str = "text", block_bytes: int = 2_000_000
) -> DataFrame:
    """A row (doc_key, item_key, run_words, aligned_words, first_word, last_word) for each document and item of which a passage lies in it.

    A passage has at least ``least_words`` words, of which ``edits`` may differ; run_words is the longest run of equal words in a row,
    aligned_words the alignment's score, first_word and last_word its place in the document (0-based). Null texts and texts of fewer words have no
    rows; repeated keys count each (rows of equal keys are merged). Other columns, whatever their names, are not looked at.
    Items are broadcast in blocks of at most ``block_bytes`` of text, by a hash of the key, each against all documents: their number may grow.
    """
    spark = documents.sparkSession
    texts = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull())
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = documents.select(F.col(doc_key).alias("_k"), F.col(doc_text).alias("_t")).filter(F.col("_t").isNotNull())
    out = None
    for b in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(ItemIndex([(k, t) for k, t in rows], least_words, edits))

        names = spark.createDataFrame([(i, k) for i, k in enumerate(_ids(rows, least_words))], f"_i int, _item {dict(items.dtypes)[item_key]}")
        found = docs.select("_k", F.explode(_finder(shared)("_t")).alias("_f")).join(F.broadcast(names), F.col("_f.item") == F.col("_i"))
        found = found.select(F.col("_k").alias(doc_key), F.col("_item").alias(item_key), F.col("_f.run").cast("long").alias("run_words"), F.col("_f.aligned").cast("long").alias("aligned_words"), F.col("_f.first").cast("long").alias("first_word"), F.col("_f.last").cast("long").alias("last_word"))
        out = found if out is None else out.unionByName(found)
    return out


def _ids(rows: list, least_words: int) -> list:
    return [k for k, t in rows if len(normal_words(t)) >= least_words]


def leaked_items(found: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id") -> DataFrame:
    """A row (item_key, n_documents, longest_run) for each item that leaked."""
    return found.groupBy(item_key).agg(F.countDistinct(doc_key).alias("n_documents"), F.max("run_words").alias("longest_run"))
