"""Problem 6: items of varying length in containers of fixed capacity, by non-negative least squares over a histogram.

1. Items beyond the capacity give off full containers; what remains of them is an item like the others.
2. The lengths of the items are counted, in bins by their length rounded up (at most ``BINS`` of them, so the counts are few).
3. Combinations of few bins that fill a window below the capacity are enumerated: pairs of bins, and as many items of one bin as go in, or some
   fewer, with up to two others that fill the rest. Non-negative least squares gives how often each is to be used so that the histogram is used
   up; the counts are rounded down, and what that leaves is taken by the same combinations as often as it goes.
4. The items of a bin are numbered in parallel (a number within a salt, behind the counts of the salts before; the salts of a bin follow from its
   count), and their number says which combination's container they go to.
5. The items left over go into containers greedily, best fit with the longest first, in groups of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .lineage import materialised

#: Most bins of length per capacity, items numbered by one task, items of a group that is packed greedily, and combinations of each bin with others.
BINS, NUMBERED, GROUP, TAILS = 256, 500_000, 20_000, 6
#: The setting that names a vocabulary of ranks, and where it is if that is unset.
TOKENIZER = ("spark.codequarry.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A row (doc_key, n_tokens) for each document with a text; tokenizer: path of a vocabulary of ranks, by default that of the setting. Empty texts have 0 tokens, null ones no row."""

    tokenizer = tokenizer or documents.sparkSession.conf.get(*TOKENIZER)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        e = _encoding(tokenizer)
        return pd.Series([len(e.encode_ordinary(t)) for t in texts], dtype="int64")

    docs = documents.select(F.col(doc_key).alias("_k"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    return docs.select(F.col("_k").alias(doc_key), count("_t").alias("n_tokens"))


# ---- combinations and their counts


def combinations(capacity: int, width: int, counts: np.ndarray, slack: float = 0.02) -> np.ndarray:
    """Rows of bins (numbers from 1 on, 0 for none) whose lengths fill the window [capacity * (1 - slack), capacity].

    Bins without items take no part. Every single bin and every pair that fill the window are there. Besides, for each bin: as many of its items as go in, and
    up to three fewer, half as many, one and two, each with up to ``TAILS`` ways (one or two items: four times as many) to fill the rest by one or two items of other bins, the fullest bins before others.
    """
    bins = np.flatnonzero(counts[1:]) + 1
    total = capacity // width
    bins = bins[bins <= total]
    low = max(1, int(np.ceil(total * (1 - slack))))
    have = np.zeros(total + 1, bool)
    have[bins] = True
    seen: dict[tuple[int, ...], None] = {(int(b),): None for b in bins if low <= b}
    for a in bins:
        for c in range(max(int(a), low - int(a)), total - int(a) + 1):
            if have[c]:
                seen[int(a), c] = None
    order = [int(b) for b in bins[np.argsort(-counts[bins], kind="stable")]]
    for b in map(int, bins):
        most = total // b
        for n in sorted({most, most - 1, most - 2, most - 3, (most + 1) // 2, 1, 2} & set(range(1, most + 1)), reverse=True):
            head, rest = (b,) * n, total - n * b
            if rest <= total - low:
                seen[head] = None
            ways = TAILS if n > 2 else 4 * TAILS
            tails = 0
            for d in range(min(rest, total), max(0, rest - (total - low)) - 1, -1):
                if d > 0 and have[d] and n > 1:
                    seen[tuple(sorted((*head, d)))] = None
                    tails += 1
                    if tails >= ways:
                        break
            tails = 0
            for c in order:
                if c < rest:
                    d = next((d for d in range(rest - c, max(0, rest - c - (total - low)) - 1, -1) if d > 0 and have[d]), 0)
                    if d:
                        seen[tuple(sorted((*head, c, d)))] = None
                        tails += 1
                        if tails >= ways:
                            break
    depth = max(map(len, seen), default=1)
    out = np.zeros((len(seen), depth), np.int64)
    for i, row in enumerate(seen):
        out[i, : len(row)] = row
    return out


def nnls(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often to use each combination: non-negative x with the least squared difference between what it uses and the counts.

    Accelerated projected gradient; of the matrix only the entries that aren't 0 are kept, each bin of a combination once.
    """
    n, k = len(counts), len(rows)
    if not k:
        return np.zeros(0)
    which, bins = np.nonzero(rows)[0], rows[rows > 0]
    cells, times = np.unique(which * n + bins, return_counts=True)
    which, bins = np.divmod(cells, n)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(bins, times * x[which], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(which, times * r[bins], k)

    scale = np.maximum(counts, 1.0) ** 0.5  # rare lengths matter as much as frequent ones
    v = np.ones(k)
    for _ in range(15):  # the largest eigenvalue, for the step
        v = back(used(v) / scale**2)
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(k)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back((used(y) - counts) / scale**2) / (1.02 * step))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(capacity: int, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, whole repeats of each) such that no bin is asked for more items than it has."""
    rows = combinations(capacity, width, counts)
    times = nnls(rows, counts.astype(float))
    most = np.sort(np.argsort(-times, kind="stable")[: 2 * len(counts)])  # as few as the bins allow: the fewer, the less is lost by rounding
    rows = np.concatenate([rows[most], np.delete(rows, most, axis=0)])
    repeats = np.zeros(len(rows), np.int64)
    repeats[: len(most)] = np.floor(nnls(rows[: len(most)], counts.astype(float)) + 1e-9)
    left = counts.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max
    for i in np.argsort(-repeats, kind="stable"):
        need = np.bincount(rows[i], minlength=len(counts))
        need[0] = 0
        can = (left[need > 0] // need[need > 0]).min()
        repeats[i] = min(repeats[i], can)
        left -= need * repeats[i]
    for i in range(len(rows)):  # what rounding down has left: once more, as often as it goes
        need = np.bincount(rows[i], minlength=len(counts))
        need[0] = 0
        can = (left[need > 0] // need[need > 0]).min()
        if can > 0:
            repeats[i] += can
            left -= need * can
    return rows[repeats > 0], repeats[repeats > 0]


def slots(rows: np.ndarray, repeats: np.ndarray, n_bins: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bin the first numbers of its runs of slots, the first container of each run, and how many items of the bin each container takes."""
    out: dict[int, list] = {b: [] for b in range(n_bins)}
    used = np.zeros(n_bins, np.int64)
    container = 0
    for row, n in zip(rows, repeats):
        bins, times = np.unique(row[row > 0], return_counts=True)
        for b, m in zip(bins, times):
            out[int(b)].append((used[b], container, m))
            used[b] += m * n
        container += n
    ends = {b: int(used[b]) for b in out}
    return {b: (*np.array(v, np.int64).T, ends[b]) for b, v in out.items() if v}


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: the longest first, each into the fullest container that takes it; equal ones in their order."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, np.int64)  # how many containers have that room
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = s + int(np.argmax(rooms[s:] > 0)) if rooms[s:].any() else -1
        if at < 0:
            c, at = n, capacity
            n += 1
        else:
            c = by_room[at].pop()
            rooms[at] -= 1
        out[i] = c
        by_room[at - s].append(c)
        rooms[at - s] += 1
    return out


def _placer(shared) -> Callable:
    @F.pandas_udf("bigint")
    def place(target: pd.Series, bins: pd.Series, number: pd.Series) -> pd.Series:
        out = np.full(len(bins), -1, np.int64)
        frame = pd.DataFrame({"t": target.to_numpy(), "b": bins.to_numpy()})
        numbers = number.to_numpy()
        for (t, b), at in frame.groupby(["t", "b"]).indices.items():
            if (got := shared.value[t].get(b)) is None:
                continue
            first, container, times, end = got
            n = numbers[at]
            i = np.searchsorted(first, n, "right") - 1
            out[at] = np.where(n < end, container[i] + (n - first[i]) // times[i], -1)
        return pd.Series(out)

    return place


def pack(items: DataFrame, targets: DataFrame, item_key: str = "doc_id", size: str = "n_tokens", target_key: str = "target_id", capacity: str = "capacity_tokens") -> DataFrame:
    """A row (target_key, item_key, piece, start, size, container) for each piece of each item, for each kind of container.

    Items up to the capacity are one piece (number 0); longer ones give off full containers from their start, and the rest is packed. start: where
    the piece begins in its item. container: a text, unique within the kind. Items of size 0 take no space and have no row, nor have null keys or
    sizes, negative sizes, and kinds with a null capacity or one below 1; kinds are few (their list comes to the driver). Repeated keys count
    each. Other columns, whatever their names, are not looked at.
    """
    spark = items.sparkSession
    kinds = [(t, int(c)) for t, c in targets.select(target_key, capacity).distinct().collect() if t is not None and c is not None and c >= 1]
    kind_type = dict(targets.dtypes)[target_key]
    kind_list = F.array(*(F.struct(F.lit(t).cast(kind_type).alias("_t"), F.lit(c).cast("long").alias("_c"), F.lit(max(1, -(-c // BINS))).cast("long").alias("_w")) for t, c in kinds)).cast(f"array<struct<_t:{kind_type},_c:bigint,_w:bigint>>")
    base = items.select(F.col(item_key).alias("_k"), F.col(size).cast("long").alias("_n")).filter((F.col("_n") > 0) & F.col("_k").isNotNull())
    base = materialised(base.withColumn("_u", F.monotonically_increasing_id()))  # read for the counts and for the result; keys may repeat
    every = base.select("*", F.explode(kind_list).alias("_kind")).select("_k", "_n", "_u", "_kind.*")  # each item for each of the few kinds
    full = (F.col("_n") / F.col("_c")).cast("long")
    rest = F.col("_n") - full * F.col("_c")

    whole = every.filter(full > 0).select("_t", "_k", "_u", F.posexplode(F.sequence(F.lit(1).cast("long"), full)).alias("_p", "_i"), "_c")
    whole = whole.select("_t", "_k", F.col("_p").cast("long").alias("piece"), (F.col("_p") * F.col("_c")).alias("start"), F.col("_c").alias("size"), F.format_string("f%d-%d", "_u", "_p").alias("container"))

    rests = every.filter(rest > 0).select("_t", "_k", "_u", "_c", "_w", full.alias("piece"), (full * F.col("_c")).alias("start"), rest.alias("size"))
    rests = rests.withColumn("_b", F.ceil(F.col("size") / F.col("_w")).cast("int"))
    # a bin's length is rounded up; one that would be longer than the capacity is left to the greedy part
    counted = rests.groupBy("_t", "_b").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds x BINS rows
    tables, total = {}, {}
    for t, c in kinds:
        width = max(1, -(-c // BINS))
        n_bins = -(-c // width) + 1
        counts = np.zeros(n_bins, np.int64)
        for r in counted:
            if r["_t"] == t:
                counts[r["_b"]] += r["n"]
        total[t] = int(counts.sum())
        usable = counts.copy()
        usable[c // width + 1 :] = 0
        rows, repeats = plan(c, usable, width)
        tables[t] = slots(rows, repeats, n_bins)
    shared = spark.sparkContext.broadcast(tables)
    # a bin of many items is numbered by several tasks; that and its share of the plan are a row a bin and salt: a row for NUMBERED items at most, and one a bin
    salts = spark.createDataFrame([(r["_t"], r["_b"], -(-r["n"] // NUMBERED)) for r in counted], f"_t {kind_type}, _b int, _m bigint")
    rests = rests.join(F.broadcast(salts), ["_t", "_b"]).withColumn("_s", F.pmod(F.xxhash64("_u"), F.col("_m"))).drop("_m")
    per = rests.filter(F.col("_s") >= 0).groupBy("_t", "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    offset = per.withColumn("_o", F.coalesce(F.sum("_n").over(W.partitionBy("_t", "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    offset = materialised(offset)
    number = F.row_number().over(W.partitionBy("_t", "_b", "_s").orderBy("_k", "piece", "_u"))
    placed = rests.withColumn("_r", number).join(F.broadcast(offset), ["_t", "_b", "_s"]).withColumn("_x", _placer(shared)("_t", "_b", F.col("_o") + F.col("_r") - 1))
    keep = ["_t", "_k", "piece", "start", "size"]
    planned = placed.filter("_x >= 0").select(*keep, F.concat(F.lit("p"), F.col("_x").cast("string")).alias("container"))

    left = placed.filter("_x < 0")
    sizes = {}
    for t, c in kinds:
        taken = sum(v[3] for v in tables[t].values())
        sizes[t] = max(1, -(-(total[t] - taken) // GROUP))
    group_table = spark.createDataFrame([(t, int(n)) for t, n in sizes.items()], f"_t {kind_type}, _g bigint")
    left = left.join(F.broadcast(group_table), "_t").withColumn("_g", F.pmod(F.xxhash64("_u", "piece"), F.col("_g")))

    def greedy(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k", "piece", "size", "_u"])
        got = best_fit(pdf["size"].to_numpy(), int(pdf["_c"].iloc[0]))
        return pdf[keep].assign(container=[f"g{key[1]}-{x}" for x in got])

    types = dict(rests.dtypes)
    packed = left.groupBy("_t", "_g").applyInPandas(greedy, ", ".join(f"{k} {types[k]}" for k in keep) + ", container string")
    out = whole.select(*keep, "container").unionByName(planned).unionByName(packed)
    return out.select(F.col("_t").alias(target_key), F.col("_k").alias(item_key), "piece", "start", "size", "container")


def fill_rates(packed: DataFrame, targets: DataFrame, target_key: str = "target_id", capacity: str = "capacity_tokens") -> DataFrame:
    """A row (target_key, n_pieces, n_containers, n_tokens, fill) for each kind: fill is the share of the containers' space that is used."""
    used = packed.groupBy(target_key, "container").agg(F.sum("size").alias("u"), F.count(F.lit(1)).alias("p"))
    total = used.groupBy(target_key).agg(F.sum("p").alias("n_pieces"), F.count(F.lit(1)).alias("n_containers"), F.sum("u").alias("n_tokens"))
    return total.join(targets.select(target_key, capacity).distinct(), target_key).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col(capacity))).drop(capacity)
