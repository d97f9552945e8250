"""TF-IDF over chunks of documents, with terms as 64-bit hashes of their words.

A chunk asks for the document frequencies of its distinct terms, each term once, and keeps its pairs of document and term to itself; what is
shuffled are texts, distinct terms of chunks with their frequencies, and the pairs with terms of queries. Scores stay in the tasks: a histogram of all
scores of a query gives a bound that its k best reach, and only what reaches it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bins of the histograms over scores from 0 to 1; queries that are scored at a time; terms of most queries, which are multiplied as a matrix. Scores that may be equal after rounding differ by less than MARGIN.
BINS, AT_ONCE, DENSE, MARGIN = 4096, 256, 256, 2e-6
#: Pairs of a term's entry and a query that are added up at a time.
PAIRS = 4_000_000

RARE = "bucket int, chunk int, hashes binary, counts binary"
ANSWER = "chunk int, bucket int, counts binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ints(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def terms(table: pa.RecordBatch | pa.Table, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all grams of one to ``most`` words. Columns: scope bigint, texts array<array<bigint>>, the hashes of each text's words."""
    texts = table.column("texts")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pa.concat_arrays([texts.chunk(i) for i in range(texts.num_chunks)]) if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = texts.flatten()
    sizes = _ints(inner.value_lengths().fill_null(0)).astype(np.int64)
    row_of = np.repeat(np.arange(len(texts)), _ints(texts.value_lengths().fill_null(0)))
    words = _ints(inner.flatten()).astype(np.int64).view(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    rows = np.repeat(row_of, sizes)
    scope = _ints(table.column("scope")).astype(np.int64).view(np.uint64)
    at = np.arange(len(words))
    h = _mix(words + _mix(scope + np.uint64(1))[rows])
    out_rows, out = [rows], [h]
    for n in range(1, most):
        keep = at + n < ends
        at, ends, h = at[keep], ends[keep], h[keep]
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + n] + np.uint64(n))
        out_rows.append(rows[at])
        out.append(h)
    return np.concatenate(out_rows), np.concatenate(out)


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, rows, places among the hashes, tf): each pair of row and hash once, by row."""
    distinct, place = np.unique(hashes, return_inverse=True)
    codes, tf = np.unique(rows * max(1, len(distinct)) + place, return_counts=True)
    r, p = np.divmod(codes, max(1, len(distinct)))
    return distinct, r, p, tf


def packed(a: np.ndarray) -> bytes:
    """The bytes of all values by their place in the value: Spark's compression of shuffles takes out the empty ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, equal ranges of hashes, begin and end among the sorted hashes."""
    step = (1 << 64) // buckets
    return np.concatenate([[0], np.searchsorted(hashes, np.array([i * step for i in range(1, buckets)], np.uint64)), [len(hashes)]]).astype(np.int64)


def frequencies_of(wanted: np.ndarray) -> Callable:
    """(scope, place, n): the document frequencies of the wanted, sorted hashes, and at place -1 the number of documents of each scope; partial ones of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sizes = np.zeros(len(wanted), np.int64), {}
        for b in batches:
            if not b.num_rows:
                continue
            s, inverse = np.unique(_ints(b.column("scope")), return_inverse=True)
            for scope, count in zip(s.tolist(), np.bincount(inverse, _ints(b.column("n"))).astype(np.int64).tolist()):
                sizes[scope] = sizes.get(scope, 0) + count
            rows, hashes = terms(b)
            at = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
            known = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
            codes = np.unique(rows[known] * max(1, len(wanted)) + at[known])
            n += np.bincount(codes % max(1, len(wanted)), minlength=len(wanted))
        there = np.flatnonzero(n)
        if sizes or len(there):
            yield pa.record_batch([pa.array([*sizes, *[0] * len(there)], pa.int64()), pa.array([*[-1] * len(sizes), *there.tolist()], pa.int32()), pa.array([*sizes.values(), *n[there].tolist()], pa.int64())], ["scope", "place", "n"])

    return run


def ask(buckets: int) -> Callable:
    """A row of RARE for each bucket: the distinct terms of a chunk, and in how many of its documents they stand."""

    def run(table: pa.Table) -> pa.Table:
        distinct, _, place, _ = counted(*terms(table))
        n = np.bincount(place, minlength=len(distinct)).astype(np.uint32)
        b = _bounds(distinct, buckets)
        out = [(i, distinct[b[i] : b[i + 1]], n[b[i] : b[i + 1]]) for i in range(buckets) if b[i] < b[i + 1]]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([i for i, _, _ in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int32()), "hashes": pa.array([packed(np.diff(h, prepend=np.uint64(0))) for _, h, _ in out], pa.binary()), "counts": pa.array([packed(c) for _, _, c in out], pa.binary())})

    return run


def answer(table: pa.Table) -> pa.Table:
    """A row of ANSWER for each of RARE of a bucket: the document frequencies over all chunks."""
    hashes = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("hashes")]
    counts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in table.column("counts")])
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.bincount(place, counts)[place].astype(np.uint64)
    ends = np.cumsum([len(h) for h in hashes])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array([packed(x) for x in np.split(n, ends[:-1])], pa.binary())})


def weighed(shared) -> Callable:
    """One row a chunk: its documents, and their pairs with wanted terms as (document, place, tf x idf at length 1)."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        wanted, sizes = shared.value.hashes, shared.value.sizes
        if not docs.num_rows:
            return docs.select(["doc"]).schema.empty_table()
        distinct, rows, place, tf = counted(*terms(docs))
        order = np.argsort(_ints(answers.column("bucket").combine_chunks())) if answers.num_rows else []
        df = np.concatenate([np.empty(0, np.uint64), *(unpacked(answers.column("counts")[int(i)].as_py(), np.uint64) for i in order)]).astype(np.float64)
        n = np.array([sizes[s] for s in docs.column("scope").to_pylist()], np.float64)
        w = tf * (np.log((1.0 + n[rows]) / (1.0 + df[place])) + 1.0)
        norm = np.sqrt(np.bincount(rows, w * w, minlength=docs.num_rows))
        at = np.minimum(np.searchsorted(wanted, distinct), len(wanted) - 1)
        known = (wanted[at] == distinct)[place]
        rows, at, w = rows[known], at[place][known], w[known] / norm[rows[known]]
        doc = docs.column("doc").combine_chunks()
        doc = pa.concat_arrays(doc.chunks) if isinstance(doc, pa.ChunkedArray) else doc
        there, rows = np.unique(rows, return_inverse=True)
        doc = doc.take(pa.array(there))
        return pa.table({"docs": pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc), "rows": pa.array([packed(rows.astype(np.int32))], pa.binary()), "places": pa.array([packed(at.astype(np.int32))], pa.binary()), "weights": pa.array([w.tobytes()], pa.binary())})

    return run


class Asked:
    """Queries as their terms' weights. hashes: of the terms, sorted; owners: by term, from starts to starts, the queries with their weights; sizes: the documents of each scope."""

    def __init__(self, info: pa.Table, query: np.ndarray, hashes: np.ndarray):
        self.info, self.n = info, info.num_rows
        self.hashes, self.query, self.place, self.tf = counted(query, hashes)
        self.sizes: dict[int, int] = {}

    def fit(self, df: np.ndarray, sizes: dict[int, int], scopes: np.ndarray) -> None:
        """df: by term; scopes: by query. Terms that no document has are dropped."""
        n = np.array([sizes.get(s, 0) for s in scopes.tolist()], np.float64)
        w = self.tf * (np.log((1.0 + n[self.query]) / (1.0 + df[self.place])) + 1.0)
        w[df[self.place] == 0] = 0
        norm = np.sqrt(np.bincount(self.query, w * w, minlength=self.n))
        keep = w > 0
        self.query, self.place, w = self.query[keep], self.place[keep], w[keep]
        self.weight, self.sizes = w / norm[self.query], sizes
        del self.tf

    def scores(self, docs: int, rows: np.ndarray, places: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, documents x queries), some queries at a time."""
        for first in range(0, self.n, AT_ONCE):
            many = min(AT_ONCE, self.n - first)
            mine = (self.query >= first) & (self.query < first + many)
            order = np.argsort(self.place[mine], kind="stable")
            place, query, weight = self.place[mine][order], self.query[mine][order] - first, self.weight[mine][order]
            size = np.bincount(place, minlength=len(self.hashes))
            start = np.cumsum(size) - size
            common = np.argsort(-size, kind="stable")[:DENSE]
            column = np.full(len(self.hashes), -1)
            column[common] = np.arange(len(common))
            left, right = np.zeros((docs, len(common))), np.zeros((len(common), many))
            dense = column[places] >= 0
            left[rows[dense], column[places[dense]]] = weights[dense]
            held = column[place] >= 0
            right[column[place[held]], query[held]] = weight[held]
            s = left @ right
            r, p, w = rows[~dense], places[~dense], weights[~dense]
            each = size[p]
            r, p, w, each = r[each > 0], p[each > 0], w[each > 0], each[each > 0]
            ends = np.cumsum(each)
            cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS)))
            for i, j in zip(cuts, [*cuts[1:], len(r)]):
                e = each[i:j]
                if len(e):
                    entry = np.repeat(start[p[i:j]] - (np.cumsum(e) - e), e) + np.arange(e.sum())
                    s += np.bincount(np.repeat(r[i:j], e) * many + query[entry], np.repeat(w[i:j], e) * weight[entry], docs * many).reshape(docs, many)
            yield first, s


def _scored(b: pa.RecordBatch, i: int, asked: Asked) -> Iterator[tuple[int, np.ndarray]]:
    row = {c: b.column(c)[i].as_py() for c in ("rows", "places", "weights")}
    return asked.scores(len(b.column("docs")[i]), unpacked(row["rows"], np.int32), unpacked(row["places"], np.int32), np.frombuffer(row["weights"], np.float64))


def histograms(shared) -> Callable:
    """(first, counts): for the queries from ``first`` on, how many documents of the task have a score of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                for first, s in _scored(b, i, shared.value):
                    r, q = np.nonzero(s > 0)
                    n = np.bincount(q * BINS + np.minimum(s[r, q] * BINS, BINS - 1).astype(np.int64), minlength=s.shape[1] * BINS).astype(np.uint32)
                    total[first] = total.get(first, 0) + n
        for first, n in total.items():
            yield pa.record_batch([pa.array([first], pa.int32()), pa.array([packed(n)], pa.binary())], ["first", "counts"])

    return run


def least(k: int) -> Callable:
    """(first, bounds): scores that the k best documents of each query reach."""

    def run(table: pa.Table) -> pa.Table:
        n = np.zeros(1, np.int64)
        for x in table.column("counts"):
            n = n + unpacked(x.as_py(), np.uint32)
        better = np.cumsum(n.reshape(-1, BINS)[:, ::-1], axis=1)
        at = np.where(better[:, -1] >= k, BINS - 1 - np.argmax(better >= k, axis=1), 0)
        return pa.table({"first": table.column("first").slice(0, 1), "bounds": pa.array([(at / BINS).tobytes()], pa.binary())})

    return run


def best(shared, names: list[str]) -> Callable:
    """(names, doc, score) of all that reach the bounds: a map of first queries to bounds stands in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs = b.column("docs")[i].values
                bounds = {x["first"]: np.frombuffer(x["bounds"], np.float64) for x in b.column("every")[i].as_py()}
                for first, s in _scored(b, i, shared.value):
                    r, q = np.nonzero((s > 0) & (s >= bounds[first] - MARGIN)) if first in bounds else ([], [])
                    if len(r):
                        info = shared.value.info.take(pa.array(q + first)).combine_chunks()
                        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (info.column(x) for x in names)]
                        yield pa.record_batch([*columns, docs.take(pa.array(r)), pa.array(s[r, q])], [*names, "doc", "score"])

    return run
