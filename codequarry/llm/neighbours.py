"""Problem 3: the k most similar vectors for every vector, by NN-descent.

Every vector begins with a list of cheap neighbours: the best of those that hash to the same small buckets (signs of random projections). Then
the lists are joined with each other, round by round: vectors that have a neighbour in common are compared, and each keeps the best it has met, until
hardly a list changes. A round sends each vector to the homes of its neighbours; vectors whose neighbours live together are sent there once. A home is
a cell of centres fitted on a sample, so that most neighbours share theirs: it tells where vectors meet, not which are compared.
``search`` walks the graph greedily.

Similarity is cosine in double precision; ties go to the smaller id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .lineage import forget, materialised

#: Vectors of the sample that the thresholds of the projections and the centres of homes are fitted on (more only where there are many centres), hashings, and vectors that a bucket should have.
SAMPLE, HASHINGS, BUCKET = 20_000, 3, 256
#: Neighbours kept in the graph, and those of them whose homes a vector is sent to; share of vectors whose k nearest still change at which the descent ends; vectors with one neighbour in common that are compared with each other.
KEPT, VISITED, CHANGES, GUESTS = 12, 10, 0.01, 8000
#: Centres of homes (bound), and vectors of the sample that each is fitted on; vectors of a cell that stay together, and of the homes that a larger one is split into; vectors in one task; pairs compared at a time.
CENTRES, FITTED, CELL, SPLIT, TOGETHER, PAIRS = 16_384, 8, 4096, 700, 50_000, 2_000_000


def usable(vectors: DataFrame, key: str, vector: str, dimensions: int = 64) -> DataFrame:
    """(id bigint, vec binary): rows whose vector has exactly so many values, all finite, not all zero. A null key, a null vector or a null in it makes a row unusable."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, "<f4").tobytes() for x in s])

    v = F.col("_v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("_v")).filter(F.col("id").isNotNull() & (F.size(v) == dimensions))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(finite).select("id", pack("_v").alias("vec"))


def _matrix(vecs: Iterable[bytes]) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(vecs), "<f4").reshape(len(vecs), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Hashing:
    """Signs of random projections against their medians: a number for each vector and hashing."""

    def __init__(self, sample: np.ndarray, bits: int, hashings: int = HASHINGS, seed: int = 7):
        planes = np.random.default_rng(seed).standard_normal((sample.shape[1], hashings * bits))
        self.planes, self.bits, self.hashings = planes, bits, hashings
        self.medians = np.median(sample @ planes, axis=0) if len(sample) else np.zeros(hashings * bits)

    def of(self, x: np.ndarray) -> np.ndarray:
        signs = (x @ self.planes > self.medians).reshape(len(x), self.hashings, self.bits)
        return (signs << np.arange(self.bits, dtype=np.int64)).sum(2)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *((x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096))])


def _centres(x: np.ndarray, n: int, steps: int = 4) -> np.ndarray:
    """Centres of n cells at the most, by a few steps of k-means from the first n vectors."""
    centres = x[:n].copy()
    for _ in range(steps):
        at = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        length = np.sqrt(np.einsum("ij,ij->i", total, total))
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    return centres


class Cells:
    """The cell of a vector: that of the nearest centre, looked for among those of the nearest of a few wide cells."""

    def __init__(self, sample: np.ndarray, n: int):
        self.wide = _centres(sample, max(1, int(np.ceil(np.sqrt(n)))))
        at = _nearest(sample, self.wide)
        own = [sample[at == i] for i in range(len(self.wide))]
        self.centres = [_centres(x, max(1, round(n * len(x) / len(sample)))) if len(x) else self.wide[i : i + 1] for i, x in enumerate(own)]
        self.first = np.cumsum([0, *map(len, self.centres)])

    def of(self, x: np.ndarray) -> np.ndarray:
        wide = _nearest(x, self.wide)
        order = np.argsort(wide, kind="stable")
        out = np.empty(len(x), np.int64)
        for own in np.split(order, np.flatnonzero(np.diff(wide[order])) + 1) if len(x) else []:
            i = wide[own[0]]
            out[own] = self.first[i] + _nearest(x[own], self.centres[i])
        return out


_LISTS = "id bigint, far array<double>, ids array<bigint>, homes array<int>"
_SCHEMA = pa.schema([("id", pa.int64()), ("far", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("homes", pa.list_(pa.int32()))])


def _lists(who: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray, homes: np.ndarray, k: int) -> pa.Table:
    """(id, far, ids, homes): the k best of each a's partners b; a and b are places in ``who``."""
    order = np.lexsort((who[b], far, a))
    firsts = np.flatnonzero(np.diff(a[order], prepend=-1))
    sizes = np.diff(np.append(firsts, len(order)))
    order = order[np.arange(len(order)) - np.repeat(firsts, sizes) < k]
    a, b, far = a[order], b[order], far[order]
    firsts = np.flatnonzero(np.diff(a, prepend=-1))
    ends = pa.array(np.append(firsts, len(a)), pa.int32())
    return pa.table([pa.array(who[a[firsts]]), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (far, who[b], homes[b].astype(np.int32)))], schema=_SCHEMA)


def _column(t: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(t.column(name).chunks)


def _hashed(k: int):
    """Compares all vectors of a bucket."""

    def run(t: pa.Table) -> pa.Table:
        n = t.num_rows
        if n < 2:
            return _SCHEMA.empty_table()
        x = _matrix(t.column("vec").to_pylist())
        far = -(x @ x.T)
        np.fill_diagonal(far, 9)
        p = min(k, n - 1)
        near = np.argpartition(far, p - 1, axis=1)[:, :p]
        rows = np.repeat(np.arange(n), p)
        near = near.ravel()
        exact = -np.einsum("ij,ij->i", x[rows], x[near])
        return _lists(t.column("id").to_numpy(), rows, near, exact, t.column("home").to_numpy(), k)

    return run


def _met(member: np.ndarray, key: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b: the members that have a key in common, about PAIRS at a time; those of a key with more than GUESTS are split by their hashes."""
    order = np.argsort(key, kind="stable")
    _, group, size = np.unique(key[order], return_inverse=True, return_counts=True)
    if size.max() > GUESTS:
        share = hashes[member[order]].astype(np.int64) % -(-size[group] // GUESTS)
        again = np.lexsort((share, group))
        order = order[again]
        _, size = np.unique(group[again] * (1 + share.max()) + share[again], return_counts=True)
    member = member[order]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(member)) - 1  # members of the group behind each
    ends = np.cumsum(left)
    for n in np.split(np.arange(len(member)), np.searchsorted(ends, np.arange(PAIRS, ends[-1] + 1, PAIRS), side="right")):
        many = left[n]
        first = np.repeat(n, many)
        yield member[first], member[first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)]


def _joined(k: int):
    """Compares the vectors that have a neighbour in common, of those whose home this is; what is no better than a list's last entry, or stands in it, isn't told again."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        who, hashes, last, via, known = t.column("id").to_numpy(), t.column("hash").to_numpy(), t.column("last").to_numpy(), _column(t, "via"), _column(t, "known")
        n, x = len(who), _matrix(t.column("vec").to_pylist())
        told = np.unique(np.repeat(np.arange(n), known.value_lengths().to_numpy()) * (1 << 32) + known.flatten().to_numpy().astype(np.int64) % (1 << 32))
        codes, fars = [], []
        for a, b in _met(np.repeat(np.arange(n), via.value_lengths().to_numpy()), via.flatten().to_numpy(), hashes):
            a, b = np.divmod(np.unique(a * n + b), n)
            far = np.concatenate([np.empty(0), *(-np.einsum("ij,ij->i", x[a[i : i + 50_000]], x[b[i : i + 50_000]]) for i in range(0, len(a), 50_000))])
            for one, other in ((a, b), (b, a)):
                better = np.flatnonzero(far <= last[one])
                one, other = one[better], other[better]
                new = ~np.isin(one * (1 << 32) + hashes[other].astype(np.int64) % (1 << 32), told)
                codes.append(one[new] * n + other[new])
                fars.append(far[better[new]])
        code, at = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_index=True)
        if not len(code):
            return _SCHEMA.empty_table()
        a, b = np.divmod(code, n)
        return _lists(who, a, b, np.concatenate(fars)[at], t.column("home").to_numpy(), k)  # of the lists' own entries, those are told by a hash

    return run


def _small(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """The rows, computed once, and marked to be broadcast if they are so few; more are joined by shuffle."""
    df = materialised(df)
    return F.broadcast(df) if df.count() <= rows else df


def _merged(lists: DataFrame, found: DataFrame, kept: int) -> DataFrame:
    """The rows of ``lists``, by id, with the best ``kept`` of their own entries and all of those found, each neighbour once. Only ``found`` is shuffled where the rows lie by id."""
    more = found.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("far", "ids", "homes"))).alias("_more"))
    old = F.arrays_zip("far", "ids", "homes")
    best = F.when(F.col("_more").isNull(), old).otherwise(F.slice(F.array_distinct(F.sort_array(F.concat(old, F.col("_more")))), 1, kept))
    rest = [c for c in lists.columns if c not in ("id", "far", "ids", "homes")]
    return lists.join(more, "id", "left").withColumn("_b", best).select("id", *(F.col(f"_b.{c}").alias(c) for c in ("far", "ids", "homes")), *rest)


@dataclass
class Index:
    """graph: (id, nbrs); hashing: the buckets of any vector; entries: (bucket, n, nv), members at which searches begin: one of each connected part at least. rounds: how many lists have changed in each."""

    graph: DataFrame
    hashing: Hashing | None = None
    entries: DataFrame | None = None
    rounds: tuple[int, ...] = ()


def neighbour_graph(vectors: DataFrame, k: int = 5, kept: int = KEPT, rounds: int | None = None) -> DataFrame:
    """The graph of build()."""
    return build(vectors, k, kept, rounds).graph


def _cell(cells: Cells, spark) -> Column:
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("bigint")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(_matrix(s)) if len(s) else np.empty(0, np.int64))

    return of("vec")


def _buckets(hashing: Hashing, spark) -> Column:
    """The buckets of a vector: a hash of the hashing's number and the signs."""
    shared = spark.sparkContext.broadcast(hashing)

    @F.pandas_udf("array<bigint>")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.of(_matrix(s)))) if len(s) else pd.Series([], dtype=object)

    return F.transform(of("vec"), lambda x, i: F.xxhash64(i, x))


def build(vectors: DataFrame, k: int = 5, kept: int = KEPT, rounds: int | None = None) -> Index:
    """An index whose graph has a row (id, nbrs) for each vector of (id, vec), as usable() gives them: nbrs has the nearest others (-cosine as far, id), the nearest first.

    The descent goes on until under CHANGES of the vectors get another k nearest, or for so many rounds as are given. Buckets of more than twice BUCKET
    vectors are split by a hash; so are those with one neighbour in common beyond GUESTS, and the guests of a home beyond TOGETHER: vectors there meet by
    way of others of their neighbours.
    A vector counts once by its id; of rows with the same id one is taken. Vectors of exactly the same bytes count as one another's neighbours like any
    others, but only the least kept + 1 ids of such a class stand in the graph: no other of it can be among anybody's k nearest, and they all have the
    least ids as their own. An empty table gives no rows; with fewer than k + 1 vectors, lists are shorter.
    """
    spark = vectors.sparkSession
    single = materialised(vectors.select("id", "vec").dropDuplicates(["id"]))
    n = single.count()
    if not n:
        return Index(spark.createDataFrame([], "id bigint, nbrs array<struct<far:double,id:bigint>>"))
    n_cells = min(CENTRES, max(1, n // BUCKET))
    most = max(SAMPLE, FITTED * n_cells)
    share = min(1.0, most / n)
    rows = single.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("vec").limit(2 * most).collect()
    rows = rows or single.select("vec").limit(1).collect()
    sample = _matrix(sorted(bytes(r.vec) for r in rows))
    hashing = Hashing(sample, max(1, int(np.ceil(np.log2(max(2, n / BUCKET))))))
    cells = Cells(np.random.default_rng(11).permutation(sample), n_cells)

    w = W.partitionBy("_h").orderBy("id")
    classes = single.withColumn("_h", F.md5("vec"))
    firsts = classes.select("_h", "id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= kept + 1)
    copies = firsts.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("id")).alias("_ids")).filter(F.col("_n") > kept)
    copies = materialised(copies)
    n_copies = copies.count()
    if n_copies:  # classes that are larger than what any list holds: their other members stay out of the graph
        salts = 1 if n_copies <= 300_000 else 32  # many classes are joined by shuffle, where the largest is split
        salted = copies.select("_h", "_ids", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
        salted = F.broadcast(salted) if salts == 1 else salted
        classes = classes.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["_h", "_s"], "left")
        last = F.col("_ids")[kept]
        own = classes.filter(F.col("id") > last).select("id", F.transform(F.slice("_ids", 1, kept), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("id"))).alias("nbrs"))
        classes = classes.filter(last.isNull() | (F.col("id") <= last))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    lie = functools.partial(materialised, adaptive=False)  # without it, Spark remembers that the rows lie by id
    nodes = lie(classes.select("id", "vec", _buckets(hashing, spark).alias("buckets"), F.xxhash64(F.lit(-1), _cell(cells, spark)).alias("cell")).repartition(int(parts), "id"))
    if n_copies:
        own = materialised(own)
    del classes, single
    forget(spark)
    sizes = nodes.select(F.explode(F.concat("buckets", F.array("cell"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 2 * BUCKET)
    sizes = _small(sizes.select("bucket", F.ceil(F.col("_n") / BUCKET).alias("_parts"), F.when(F.col("_n") > CELL, F.ceil(F.col("_n") / SPLIT)).otherwise(1).alias("_homes")))

    def part(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.coalesce(of, F.lit(1)))

    nodes = nodes.withColumn("bucket", F.col("cell")).join(sizes, "bucket", "left").select("id", "vec", "buckets", F.hash("cell", part("_homes")).alias("home"))
    spread = nodes.select("id", "vec", "home", F.explode("buckets").alias("bucket")).join(sizes, "bucket", "left").withColumn("part", part("_parts"))
    first = spread.groupBy("bucket", "part").applyInArrow(_hashed(kept // 2), _LISTS)
    none = [F.array().cast("array<double>").alias("far"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<int>").alias("homes")]
    graph = lie(_merged(nodes.select("id", *none), first, kept))
    del first, spread
    forget(spark)
    changed: list[int] = []
    while rounds is None or len(changed) < rounds:
        entries = F.concat(F.array(F.struct(F.col("home").alias("homes"), F.col("id").alias("ids"))), F.slice(F.arrays_zip("homes", "ids"), 1, VISITED))
        calls = F.transform(F.array_distinct(F.transform(entries, lambda x: x["homes"])), lambda h: F.struct(h.alias("to"), F.transform(F.filter(entries, lambda x: x["homes"] == h), lambda x: x["ids"]).alias("via")))
        last = F.when(F.size("far") >= kept, F.element_at("far", -1)).otherwise(9.0)
        known = F.transform("ids", lambda x: F.hash(x))
        guests = graph.join(nodes.select("id", "vec", "home"), "id").select("id", "vec", "home", last.alias("last"), known.alias("known"), F.explode(calls).alias("_c")).select("id", "vec", "home", "last", "known", F.hash("id").alias("hash"), "_c.*")
        crowds = _small(guests.groupBy("to").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TOGETHER).select("to", F.ceil(F.col("_n") / TOGETHER).alias("_shares")))
        guests = guests.join(crowds, "to", "left").withColumn("share", F.pmod(F.xxhash64("id"), F.coalesce("_shares", F.lit(1)))).drop("_shares")
        found = guests.groupBy("to", "share").applyInArrow(_joined(kept), _LISTS)
        both = _merged(graph.select("id", "far", "ids", "homes", F.slice("ids", 1, k).alias("_before")), found, kept)
        after = lie(both.select("*", (F.slice("ids", 1, k) != F.col("_before")).alias("changed")).drop("_before"))
        graph = after
        del guests, found, both, after
        forget(spark)
        changed.append(graph.filter("changed").count())
        if changed[-1] < CHANGES * n:
            break
    lists = graph.select("id", F.zip_with("far", "ids", lambda f, i: F.struct(f.alias("far"), i.alias("id"))).alias("nbrs"))
    if n_copies:
        lists = lists.unionByName(own)
    # those whose hash is less than all their neighbours': each part of the graph that hangs together has one at least
    least = F.array_min(F.transform("ids", lambda x: F.xxhash64(x)))
    chosen = graph.filter(F.coalesce(F.xxhash64("id") < least, F.lit(True))).select("id").join(nodes.select("id", "vec"), "id")
    entries = chosen.select(F.explode(_buckets(hashing, spark)).alias("bucket"), F.col("id").alias("n"), F.col("vec").alias("nv"))
    return Index(lists, hashing, entries, tuple(changed))


def neighbour_pairs(graph: DataFrame, k: int = 5) -> DataFrame:
    """A row (vec_a, vec_b), the smaller id first, for each two vectors of which one is among the other's k nearest."""
    e = graph.select("id", F.explode(F.slice("nbrs", 1, k)).alias("_e")).select("id", F.col("_e.id").alias("other"))
    return e.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 48) -> DataFrame:
    """A row (query, rank, id, cosine) for the k nearest vectors of each query (id, vec), by greedy search of the graph.

    Each query starts from the entries of its buckets, looks up the neighbours of the best half of the ``beam`` vectors it has seen best, and ends
    when those are all opened; a query that is itself in the graph is not among its own results. A query whose buckets have no entry starts from the entries
    of a bucket by its hash. An empty index gives no rows.
    All queries take a step together: a join with the graph's lists, and one with the vectors.
    """
    spark = vectors.sparkSession
    if index.hashing is None:
        return spark.createDataFrame([], "query bigint, rank bigint, id bigint, cosine double")

    @F.pandas_udf("double")
    def far(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(-np.einsum("ij,ij->i", _matrix(a), _matrix(b)) if len(a) else np.empty(0))

    q = materialised(queries.select(F.col("id").alias("q"), F.col("vec").alias("qv")).dropDuplicates(["q"]))
    vectors = vectors.dropDuplicates(["id"])
    graph = index.graph
    entries = materialised(index.entries)
    asked = q.withColumnRenamed("qv", "vec").select("q", F.col("vec").alias("qv"), F.explode(_buckets(index.hashing, spark)).alias("bucket"))
    met = asked.join(entries, "bucket")
    lost = q.join(met.select("q").distinct(), "q", "left_anti")
    any_of = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).orderBy("bucket").limit(1).select("bucket")
    met = met.select("q", "qv", "n", "nv").unionByName(lost.crossJoin(F.broadcast(any_of)).join(entries, "bucket").select("q", "qv", "n", "nv"))  # one bucket only
    state = met.dropDuplicates(["q", "n"]).select("q", far("qv", "nv").alias("far"), "n", F.lit(False).alias("open"))
    top = W.partitionBy("q").orderBy("far", "n")
    state = materialised(state.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= beam).drop("_r"))
    links = graph.select(F.col("id").alias("n"), F.transform("nbrs", lambda x: x["id"]).alias("to"))
    while True:  # ends: each step opens vectors, and a query has no more than the graph
        now = state.withColumn("_r", F.row_number().over(top)).filter((F.col("_r") <= beam // 2) & ~F.col("open"))
        reached = now.join(links, "n").select("q", F.explode("to").alias("n")).distinct().join(state.select("q", "n"), ["q", "n"], "left_anti")
        new = reached.join(vectors.select(F.col("id").alias("n"), F.col("vec").alias("nv")), "n").join(q, "q").select("q", far("qv", "nv").alias("far"), "n", F.lit(False).alias("open"))
        opened = state.withColumn("_r", F.row_number().over(top)).select("q", "far", "n", (F.col("open") | (F.col("_r") <= beam // 2)).alias("open"))
        both = opened.unionByName(new).withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= beam).drop("_r")
        state = materialised(both)
        if not state.withColumn("_r", F.row_number().over(top)).filter((F.col("_r") <= beam // 2) & ~F.col("open")).limit(1).count():
            break
    best = state.filter(F.col("q") != F.col("n")).withColumn("rank", F.row_number().over(top))
    return best.filter(F.col("rank") <= k).select(F.col("q").alias("query"), F.col("rank").cast("long").alias("rank"), F.col("n").alias("id"), (-F.col("far")).alias("cosine"))
