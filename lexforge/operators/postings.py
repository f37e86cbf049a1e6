"""BM25 of packed postings in numpy: weights of all queries as arrays, the best documents of a task kept as it reads.

A document is a row of numbers of terms and their counts, so that nothing is shuffled by word, and a task hands on the
``k`` best of each query instead of a score for every pair of query and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.5, 0.75
#: Scores are compared at 9 decimals; whatever is nearer than this to a bar is kept.
SLACK = 1e-8
#: Cells of a matrix of scores at most, 32 MB.
CELLS = 1 << 22


@dataclass(frozen=True)
class Weights:
    """What each of ``queries`` gives for each of ``terms``: rows of a matrix for terms that many queries ask (``place``
    is the row, -1 for others), lists of (query, weight) from ``start`` for the rest."""

    queries: pa.Array
    terms: pa.Array
    avgdl: float
    place: np.ndarray
    many: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(asked: pa.Table, known: pa.Table, n: int, avgdl: float) -> Weights:
        """Of ``asked(query_id, term, qtf)`` and ``known(term, df)`` over ``n`` documents; other terms weigh nothing."""
        column = lambda c: pc.dictionary_encode(asked[c].combine_chunks(), null_encoding="encode")
        q, t = column("query_id"), column("term")
        terms = t.dictionary
        df = np.zeros(len(terms))
        df[pc.index_in(known["term"].combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False).astype(int)] = known["df"].to_numpy()
        query, term = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (q, t))
        w = asked["qtf"].to_numpy() * np.log((n - df + 0.5) / (df + 0.5) + 1)[term]
        here = df[term] > 0
        query, term, w = query[here], term[here], w[here]
        per = np.bincount(term, minlength=len(terms))
        heavy = np.flatnonzero(per > max(8, len(q.dictionary) // 8))
        place = np.full(len(terms), -1)
        place[heavy] = np.arange(len(heavy))
        many = np.zeros((len(heavy), len(q.dictionary)))
        top = place[term] >= 0
        many[place[term[top]], query[top]] = w[top]
        query, term, w = query[~top], term[~top], w[~top]
        order = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        return Weights(q.dictionary, terms, avgdl or 0.0, place, many, start, query[order], w[order])

    def at_once(self) -> int:
        """Documents whose scores are taken together."""
        return max(1, min(1024, CELLS // max(1, self.many.shape[0], self.many.shape[1])))

    def scores(self, n: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """A row for each of ``n`` documents, a column a query, of entries side by side."""
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / max(self.avgdl, 1.0)))
        h, q = self.many.shape
        row = self.place[term]
        top = row >= 0
        held = np.bincount(doc[top] * h + row[top], weights=share[top], minlength=n * h).reshape(n, h)
        doc, term, share = doc[~top], term[~top], share[~top]
        times = self.start[term + 1] - self.start[term]
        at = np.repeat(np.arange(len(term)), times)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + self.start[term][at]
        rest = np.bincount(doc[at] * q + self.query[pos], weights=share[at] * self.weight[pos], minlength=n * q).reshape(n, q)
        return held @ self.many + rest


class Best:
    """The ``k`` best documents of each query among those seen, ties at 9 decimals to the smaller id."""

    def __init__(self, weights: Weights, k: int):
        self.weights, self.k, self.kind = weights, k, pa.int64()
        self.bar = np.zeros(len(weights.queries))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.full = 0, 4 * k * len(weights.queries) + 100_000

    def add(self, column: pa.Array, scores: np.ndarray) -> None:
        self.kind = column.type
        ids = np.array(column.to_pylist(), object) if column.null_count else column.to_numpy(zero_copy_only=False)
        if len(ids) > self.k:
            self.bar = np.maximum(self.bar, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        d, q = np.nonzero((scores > 0) & (scores >= self.bar - SLACK))
        self.found.append((q, ids[d], scores[d, q]))
        self.size += len(q)
        if self.size > self.full:
            self._prune()

    def _prune(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(*self.found))
        by = np.round(score, 9)
        place = pc.rank(pa.array(ids, self.kind), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -by, q))
        q, ids, score, by = q[order], ids[order], score[order], by[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.bar[q[last]] = np.maximum(self.bar[q[last]], by[last])
        keep = rank < self.k
        self.found, self.size = [(q[keep], ids[keep], score[keep])], int(keep.sum())

    def table(self) -> pa.RecordBatch:
        self._prune()
        q, ids, score = self.found[0]
        return pa.RecordBatch.from_arrays([self.weights.queries.take(pa.array(q, pa.int64())), pa.array(ids, self.kind), pa.array(score, pa.float64())], ["query_id", "id", "score"])


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, and its values."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def pack(terms: pa.Array):
    """For mapInArrow: ``id, tokens`` to ``id, dl, terms, tfs``, the places of ``terms`` that a text holds and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, tokens = flat(b.column("tokens"))
            code = pc.index_in(tokens, value_set=terms.cast(tokens.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)[code >= 0]
            key, tf = np.unique(doc * max(1, len(terms)) + code[code >= 0], return_counts=True)
            doc, code = np.divmod(key, max(1, len(terms)))
            ends = pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), *lists], ["id", "dl", "terms", "tfs"])

    return run


def best(weights: Weights, k: int):
    """For mapInArrow: ``id, terms, tfs, dls`` to ``query_id, id, score``, the ``k`` best of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Best(weights, k)
        for whole in batches:
            for at in range(0, whole.num_rows, weights.at_once()):
                b = whole.slice(at, weights.at_once())
                size, term = flat(b.column("terms"))
                tf, dl = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tfs", "dls"))
                doc = np.repeat(np.arange(len(size)), size)
                top.add(b.column("id"), weights.scores(len(size), doc, term.to_numpy(zero_copy_only=False), tf, dl))
        if top.found:
            yield top.table()

    return run
