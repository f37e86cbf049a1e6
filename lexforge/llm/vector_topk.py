"""Exact top-k by inner product with no-random-access aggregation.

Candidates lie in blocks of near vectors: a bounded sample gives pivots, each row goes to its nearest one, and
crowded cells are split by hash. Every component of a block is a list sorted by value, read from the top for
positive query components and from the bottom for negative ones, a stretch at a time.

- A query first reads its own block; its k-th score there is the bar for all other blocks.
- In each block the entries read give every candidate a lower and an upper score bound. The bar rises with the k-th
  lower bound; candidates under it are out, those not seen in any list with them. A query whose bound for everything
  unread is under its bar leaves a block at once.
- Few are left when a query stops; their scores are then resolved exactly in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import cut, importable

CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 2048
#: Queries read together, which bounds memory.
TOGETHER = 256
#: Pivots at most; each is a row of the sample sent to the driver.
PIVOTS = 256
FOUND = "query_id bigint, version bigint, vec_id bigint, score bigint"


def nra(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query index, row index) that hold every top-k row of a query that can pass its ``bar``, and the
    number of list entries read for them.

    Every list is the order of one component, read a stretch at a time. Only entries newly read change the sum of a
    row's seen parts; its unseen parts lie between the last entry read of their list and the end of it. Reading stops when
    no row unseen everywhere can qualify and resolving those left costs less than reading on. ``own`` marks pairs that
    take no part. Bounds have slack for their last digits; they only exclude.
    """
    q, bar, x = queries.astype(float), bar.astype(float), np.ascontiguousarray(rows.T.astype(float))
    width, b = x.shape
    order = np.argsort(x, axis=1, kind="stable")
    ranked = np.take_along_axis(x, order, axis=1)
    # Best entries first: ascending lists for negative query components, descending ones for positive.
    lists, values = (np.stack([v, v[:, ::-1]]) for v in (order, ranked))
    low, high = ranked[:, 0], ranked[:, -1]
    slack = 1e-5 * (1 + np.abs(q) @ np.maximum(np.abs(low), np.abs(high)))
    # Nothing read yet: the best that any row could score.
    best = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
    pairs, read = [], 0
    for i in range(len(q)):
        live = np.flatnonzero(~own[i])
        if best[i] < bar[i] - slack[i]:
            continue
        used = np.flatnonzero(q[i])
        side, w, base = (q[i, used] > 0).astype(int), q[i, used], b * np.arange(len(used))[:, None]
        worst = w * values[side, used, -1]
        total, seen, depth, outside = np.zeros(b), np.zeros(len(used) * b, np.float32), 0, True
        while len(used) and depth < b and len(live) > 2 * k and (outside or len(live) > b - depth):
            to = min(b, depth + max(1, b // 8 if depth else b // 16))
            at, part = lists[side, used, depth:to], values[side, used, depth:to] * w[:, None]
            total += np.bincount(at.ravel(), part.ravel(), b)
            seen[(at + base).ravel()] = 1
            depth, read, last = to, read + at.size, part[:, -1]
            marks = seen.reshape(len(used), b)
            lower, upper = (total + (end.sum() - end.astype(np.float32) @ marks) for end in (worst, last))
            if len(live) >= k:
                bar[i] = max(bar[i], np.partition(lower[live], len(live) - k)[len(live) - k] - slack[i])
            live = live[upper[live] >= bar[i] - slack[i]]
            outside = last.sum() >= bar[i] - slack[i]
        pairs.append((np.full(len(live), i), live))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(p for p, _ in pairs)]), np.concatenate([none, *(p for _, p in pairs)]), read


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact; beyond the ends of a bigint they stay at its ends."""
    if q.dtype == float:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 1 << 62:
        return np.einsum("ij,ij->i", q, x)
    whole = (q.astype(object) * x.astype(object)).sum(axis=1)
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in whole], np.int64)


def _best(queries: np.ndarray, rows: np.ndarray, qi: np.ndarray, xi: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    score = np.zeros(len(qi), np.int64)
    if int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(queries.shape[1], 1) < 1 << 53:
        queries, rows = queries.astype(float), rows.astype(float)  # whole numbers that doubles hold exactly
    for at in range(0, len(qi), 1 << 14):
        s = slice(at, at + (1 << 14))
        score[s] = _scores(queries[qi[s]], rows[xi[s]])
    order = np.lexsort((ids[xi], ~score, qi))  # ~ turns the order round, without the overflow of a minus
    qi, xi, score = qi[order], xi[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    top = rank < k
    return qi[top], xi[top], score[top]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of ``c(vec_id, vector)`` for each of ``q(vec_id, version, vector, bar)``, null bars for none."""
    found = [pd.DataFrame({"query_id": [], "version": [], "vec_id": [], "score": []}, dtype="int64")]
    if len(q) and len(c):
        width = max(*map(len, q.vector), *map(len, c.vector), 0)
        rows, ids = _matrix(c.vector, width), c.vec_id.to_numpy()
        for at in range(0, len(q), TOGETHER):
            some = q.iloc[at : at + TOGETHER]
            asked, names = _matrix(some.vector, width), some.vec_id.to_numpy()
            bar = some.bar.to_numpy(dtype=float, na_value=-np.inf)
            qi, xi, _ = nra(asked, rows, names[:, None] == ids[None, :], k, np.where(np.isnan(bar), -np.inf, bar))
            qi, xi, score = _best(asked, rows, qi, xi, ids, k)
            found.append(pd.DataFrame({"query_id": names[qi], "version": some.version.to_numpy()[qi], "vec_id": ids[xi], "score": score}))
    return pd.concat(found)


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell, the number of the nearest pivot."""
    if len(pivots) < 2:
        return df.withColumn("cell", F.lit(0))
    half = (pivots.astype(float) ** 2).sum(axis=1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            width = max(pivots.shape[1], *map(len, b.vector), 0)
            x = _matrix(b.vector, width)[:, : pivots.shape[1]].astype(float)
            yield b.assign(cell=np.argmax(x @ pivots.T.astype(float) - half, axis=1).astype(np.int32) if len(b) else np.zeros(0, np.int32))

    return df.mapInPandas(run, "vec_id bigint, vector array<bigint>, cell int")


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates by integer inner product.

    Both inputs have vec_id and vector (array<bigint>); a row takes no part for its own vec_id. Repeated query rows are
    one query; a query vec_id with several vectors gives a list for each of them. Null vectors and
    null vec_ids are dropped; shorter vectors count as padded with zeros; ties go to the smaller vec_id; repeated
    candidates stand for themselves each; scores beyond a bigint stay at its ends; fewer than k candidates give
    fewer rows; empty inputs give none; other columns are ignored.
    """
    importable(candidates.sparkSession)
    clean = lambda d: d.select("vec_id", "vector").where("vec_id is not null and vector is not null and forall(vector, x -> x is not null)")
    queries, candidates = clean(queries).distinct(), clean(candidates)
    total = candidates.count()
    wanted = min(PIVOTS, total // CANDIDATES_PER_BLOCK)
    sample = [r["vector"] for r in candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()] if wanted > 1 else []
    pivots = _matrix(pd.Series(sample, dtype=object), max(map(len, sample), default=0))
    rows, asked = cut(_placed(candidates, pivots)), cut(_placed(queries, pivots))
    # Blocks of each cell, at most PIVOTS numbers.
    n = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    parts = [-(-n.get(c, 1) // CANDIDATES_PER_BLOCK) for c in range(max(1, len(pivots)))]
    first, blocks = np.cumsum([0, *parts[:-1]]).tolist(), sum(parts)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    block = (of(first) + F.pmod(F.xxhash64("vec_id"), of(parts))).cast("int")
    rows, asked = rows.withColumn("block", block).drop("cell"), asked.withColumn("home", block).drop("cell").withColumn("version", F.xxhash64("vector"))

    near = asked.select("vec_id", "version", "vector", F.lit(None).cast("bigint").alias("bar"), F.col("home").alias("block"))
    own = cut(near.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(lambda q, c: _search(q, c, k), FOUND))
    found = own
    if blocks > 1:
        bars = own.groupBy("query_id", "version").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
        held = asked.join(bars.withColumnRenamed("query_id", "vec_id"), ["vec_id", "version"], "left")
        groups = max(1, math.ceil(asked.count() / QUERIES_PER_BLOCK))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        far = held.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("qb"), every(blocks).alias("block")).where("block != home")
        right = rows.select("vec_id", "vector", every(groups).alias("qb"), "block")
        others = far.groupBy("qb", "block").cogroup(right.groupBy("qb", "block")).applyInPandas(lambda q, c: _search(q, c, k), FOUND)
        found = own.unionByName(others)
    best = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and vector = floor(scale * x), at the ends of a bigint where it is beyond them.

    Vectors null or holding null or non-finite values are dropped; an empty vector stays.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("bigint")).alias("vector"))
