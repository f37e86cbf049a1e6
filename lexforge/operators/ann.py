"""An approximate vector index: trained cells, residuals coded by product quantisation, a short list scored exactly.

Cells are k-means centres of a sample, about the root of the rows many. A row is kept as its cell and one byte for each
slice of its residual. A query reads the codes of its nearest cells only, estimates scores from a table of
products a slice, and looks up the vectors of its best few estimates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import cosine
from lexforge.session import cut, importable

#: Sampled rows a cell for its training, and at most for the codebooks; slices of a residual and values of each.
ROWS_PER_CELL, CODEBOOK_ROWS, SLICES, VALUES = 64, 16_384, 16, 256
#: Rows of one cell that one task reads; larger cells are split by hash.
ROWS_PER_TASK = 16_384


@dataclass(frozen=True)
class AnnIndex:
    """codes(id, cell, code) and vectors(id, v) of every row; centres and books as arrays of bounded size."""

    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    books: np.ndarray  # slices x values x width


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _stack(v: pd.Series, dims: int) -> np.ndarray:
    return _unit(np.array([*v], float).reshape(len(v), dims))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def _sliced(x: np.ndarray, slices: int) -> np.ndarray:
    """slices x rows x width; the last slice is filled up with zeros."""
    width = -(-x.shape[1] // slices)
    whole = np.zeros((len(x), slices * width))
    whole[:, : x.shape[1]] = x
    return whole.reshape(len(x), slices, width).transpose(1, 0, 2)


def _books(residuals: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows, a codebook a slice."""
    slices = max(1, min(SLICES, residuals.shape[1]))
    books = []
    for part in _sliced(residuals, slices):
        c = part[np.linspace(0, len(part) - 1, min(VALUES, len(part))).astype(int)].copy()
        for _ in range(rounds):
            at = _nearest(part, c)
            n = np.bincount(at, minlength=len(c))
            sums = np.stack([np.bincount(at, part[:, j], len(c)) for j in range(part.shape[1])], axis=1)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(c)
    return np.stack(books)


def build(vectors: DataFrame, sample_per_cell: int = ROWS_PER_CELL) -> AnnIndex:
    """The index of every row of ``vectors(id, v)`` of the most frequent length; null and zero vectors are left out.

    Cells are trained by Spark on ``sample_per_cell`` rows a cell, drawn by a hash of the id; codebooks on at most
    ``CODEBOOK_ROWS`` residuals.
    """
    spark = vectors.sparkSession
    importable(spark)
    v = F.col("v").cast("array<double>")
    whole = vectors.where("id is not null and v is not null").select("id", v.alias("v")).where("exists(v, x -> x != 0) and forall(v, x -> x is not null)")
    sizes = whole.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, n = (sizes[0]["dims"], sizes[0]["count"]) if sizes else (1, 0)
    whole = whole.where(F.size("v") == dims)
    cells = max(1, math.isqrt(n))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sample = cut(whole.orderBy(F.xxhash64("id"), "id").limit(sample_per_cell * cells).select("id", F.transform("v", lambda x: x / norm).alias("v")))
    if n:
        model = KMeans(k=cells, maxIter=8, seed=7, initMode="random").fit(sample.select(array_to_vector("v").alias("features")))
        centres = np.stack(model.clusterCenters())
    else:
        centres = np.zeros((1, dims))
    some = sample.orderBy(F.xxhash64("id"), "id").limit(CODEBOOK_ROWS).collect()
    x = np.array([r["v"] for r in some], float).reshape(len(some), dims) if some else np.zeros((1, dims))
    books = _books(x - centres[_nearest(x, centres)])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _stack(b.v, dims)
                cell = _nearest(x, centres)
                code = np.stack([_nearest(p, c) for p, c in zip(_sliced(x - centres[cell], len(books)), books)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"id": b.id, "cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    codes = whole.mapInPandas(encode, f"id {dict(whole.dtypes)['id']}, cell int, code binary")
    return AnnIndex(cut(codes), whole, centres, books)


def short_list(index: AnnIndex, queries: DataFrame, size: int, probes: float) -> DataFrame:
    """query_id, id, q: the ``size`` best estimates of each of ``queries(query_id, q)`` in its nearest cells."""
    centres, books = index.centres, index.books
    dims, most = centres.shape[1], max(1, math.ceil(probes * len(centres)))
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where((F.size("q") == dims) & F.exists("q", lambda x: x != 0))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _stack(b.q, dims)
                yield b.assign(cells=list(np.argsort(-(x @ _unit(centres).T), axis=1, kind="stable")[:, :most].astype(np.int32)))

    kind = dict(asked.dtypes) | dict(index.codes.dtypes)
    sizes = {r["cell"]: -(-r["count"] // ROWS_PER_TASK) for r in index.codes.groupBy("cell").count().collect()}  # a number a cell
    parts = F.element_at(F.array(*[F.lit(sizes.get(c, 1)) for c in range(len(centres))]), F.col("cell") + 1)
    spread = asked.mapInPandas(near, f"query_id {kind['query_id']}, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    placed = index.codes.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))

    def estimate(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "estimate": []})
        x, cell = _stack(q.q, dims), int(c.cell.iloc[0])
        code = np.frombuffer(b"".join(c.code), np.uint8).reshape(len(c), len(books))
        score = np.repeat((x @ centres[cell])[:, None], len(c), axis=1)
        for part, book, column in zip(_sliced(x, len(books)), books, code.T):
            score += (part @ book.T)[:, column]
        score[q.query_id.to_numpy()[:, None] == c.id.to_numpy()[None, :]] = -np.inf
        keep = min(size, len(c))
        at = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        i = np.repeat(np.arange(len(q)), keep)
        return pd.DataFrame({"query_id": q.query_id.to_numpy()[i], "id": c.id.to_numpy()[at.ravel()], "estimate": score[i, at.ravel()]})

    found = spread.groupBy("cell", "part").cogroup(placed.groupBy("cell", "part")).applyInPandas(estimate, f"query_id {kind['query_id']}, id {kind['id']}, estimate double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "id"))
    few = found.where(F.col("estimate") > float("-inf")).withColumn("_r", best).where(F.col("_r") <= size)
    return few.join(asked, "query_id").select("query_id", "id", "q")


def search(index: AnnIndex, queries: DataFrame, k: int, probes: float = 0.65, shortlist: int = 10) -> DataFrame:
    """query_id, id, score, rank by cosine: the best of ``shortlist * k`` rows, chosen by their codes among the nearest
    share ``probes`` of all cells. A row does not match its own id; ties at 9 decimals go to the smaller id."""
    few = short_list(index, queries, shortlist * k, probes)
    scored = few.join(index.vectors, "id").select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score")).where("score is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
