"""Rank fusion, boosting, reranking, diversity and gating of result lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import simple_words
from lexforge.session import importable

RRF_K = 60
METRICS = ("cosine", "dotproduct", "euclidean")
VECTORS_PER_BLOCK, QUERIES_AT_ONCE = 2048, 1024


def _near(q: np.ndarray, c: np.ndarray, metric: str, out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that hold the k best rows of ``c`` for each row of ``q``, with slack for the last digits.

    ``out`` marks pairs that take no part.
    """
    dot, qq, cc = q @ c.T, (q * q).sum(axis=1)[:, None], (c * c).sum(axis=1)[None, :]
    if metric == "cosine":
        near, slack = dot / (np.sqrt(qq) * np.sqrt(cc)), 1e-8
    elif metric == "dotproduct":
        near, slack = dot, 1e-8 + 1e-12 * np.sqrt(qq) * np.sqrt(cc.max(initial=0))
    else:  # squares are compared: their error follows the norms, that of a small root does not
        near, slack = 2 * dot - qq - cc, 1e-12 * (qq + cc.max(initial=0))
    if len(c) <= k or not np.isfinite(near[~out]).all():
        return np.nonzero(~out)
    near[out] = -np.inf
    bar = np.partition(near, len(c) - k, axis=1)[:, len(c) - k, None]
    if metric == "euclidean":
        bar = -((np.sqrt(np.maximum(slack - bar, 0)) + 1e-8) ** 2)
    return np.nonzero(~out & (near >= bar - slack))


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of paired rows; equal pairs score equally wherever they stand."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    if metric == "euclidean":
        return -np.sqrt(dot(q - c, q - c))
    return dot(q, c) if metric == "dotproduct" else dot(q, c) / (np.sqrt(dot(q, q)) * np.sqrt(dot(c, c)))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", limit: int = 10_000, within: str | None = None) -> DataFrame:
    """query_id, id, score, rank of the k nearest vectors; a vector does not match itself.

    ``within`` names a column of both: only vectors of the query's own value there (its namespace) are searched, all
    namespaces in one plan; rows without one take no part.

    Any number of ``queries(query_id, q)`` and ``vectors(id, v)``: queries are dealt by hash into blocks of
    about ``limit`` rows and vectors into blocks of ``VECTORS_PER_BLOCK``, every pair of blocks is one group,
    and the k best of each group are merged. Pairs of unequal length, with a null or without a cosine have
    no score. Ties at 9 decimals go to the smaller id.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    importable(vectors.sparkSession)
    space = F.col(within) if within else F.lit(0)
    whole = lambda d, i, v: d.where(F.col(i).isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull()) & space.isNotNull()).select(i, F.col(v).cast("array<double>").alias(v), space.alias("space"))
    queries, vectors = whole(queries, "query_id", "q"), whole(vectors, "id", "v")
    nq, nc = max(1, math.ceil(queries.count() / limit)), max(1, math.ceil(vectors.count() / VECTORS_PER_BLOCK))
    block = lambda i, v, n: F.pmod(F.xxhash64(i, v), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "q", "space", block("query_id", "q", nq).alias("qb"), every(nc).alias("cb"))
    right = vectors.select("id", "v", "space", every(nq).alias("qb"), block("id", "v", nc).alias("cb"))
    names = ["query_id", "id", "score", "by"]

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({n: [] for n in names})]
        order = np.unique(c.id.to_numpy(), return_inverse=True)[1]
        c_len = c.v.map(len).to_numpy()
        for at in range(0, len(q) if len(c) else 0, QUERIES_AT_ONCE):
            part = q.iloc[at : at + QUERIES_AT_ONCE]
            q_len = part.q.map(len).to_numpy()
            for n in sorted(set(q_len) & set(c_len)):
                qi, ci = np.flatnonzero(q_len == n), np.flatnonzero(c_len == n)
                x, y = (np.stack([*v]).reshape(len(v), n) for v in (part.q.iloc[qi], c.v.iloc[ci]))
                out = part.query_id.to_numpy()[qi][:, None] == c.id.to_numpy()[ci][None, :]
                if metric == "cosine":
                    length = lambda m: np.sqrt((m * m).sum(axis=1))
                    out |= length(x)[:, None] * length(y)[None, :] == 0
                with np.errstate(all="ignore"):
                    i, j = _near(x, y, metric, out, k)
                    score = np.concatenate([np.zeros(0), *(_scores(x[i[s : s + 65536]], y[j[s : s + 65536]], metric) for s in range(0, len(i), 65536))])
                by = np.round(score, 9) + 0.0
                # As Spark sorts, NaN comes before all numbers.
                best = np.lexsort((order[ci[j]], -by, ~np.isnan(by), i))
                i, j, score, by = i[best], j[best], score[best], by[best]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append(pd.DataFrame(dict(zip(names, (part.query_id.to_numpy()[qi[i[top]]], c.id.to_numpy()[ci[j[top]]], score[top], by[top])))))
        return pd.concat(found[1:] or found)

    kind = dict(left.dtypes) | dict(right.dtypes)
    found = left.groupBy("space", "qb", "cb").cogroup(right.groupBy("space", "qb", "cb")).applyInPandas(search, f"query_id {kind['query_id']}, id {kind['id']}, score double, by double")
    best = Window.partitionBy("query_id").orderBy(F.desc("by"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("by")


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``lists(list_id, query_id, id, score)``: query_id, id, score, best, found_by."""
    rank = F.row_number().over(Window.partitionBy("query_id", "list_id").orderBy(F.desc(F.round("score", 9)), "id"))
    ranked = lists.withColumn("r", rank)
    return ranked.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("r"))).alias("score"),
        F.max(F.struct("score")).getField("score").alias("best"),
        F.array_sort(F.collect_set("list_id")).alias("found_by"),
    )


def min_max(df: DataFrame, by: list[str], score: str = "score") -> Column:
    """Scores scaled to 0..1 within groups; a group of equal scores gets 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0))


def weighted_fuse(a: DataFrame, b: DataFrame, wa: float, wb: float) -> DataFrame:
    """Full outer join of two lists (query_id, id, score), min-max scaled and weighted; a missing side is 0."""
    x = a.select("query_id", "id", min_max(a, ["query_id"]).alias("sa"))
    y = b.select("query_id", "id", min_max(b, ["query_id"]).alias("sb"))
    both = x.join(y, ["query_id", "id"], "full_outer")
    score = wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0))
    return both.select("query_id", "id", score.alias("score"))


def boost(text: Column, terms: Column, score: Column, factor: float = 5.0) -> Column:
    """Score times factor when the lower-cased text contains any of the terms (an array)."""
    hit = F.exists(terms, lambda t: F.contains(F.lower(text), t))
    return F.when(hit, score * factor).otherwise(score)


def rerank(results: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Scores by position (query_id, pos, new_score) replace old ones; positions without keep theirs.

    Scores are compared at 9 decimals, ties go to the earlier position: copies score alike but for their last digits,
    which follow the order of addition.
    """
    joined = results.join(scores, ["query_id", "pos"], "left").withColumn("score", F.coalesce("new_score", "score")).drop("new_score")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Greedy diversity of ``candidates(query_id, id, score, text)``: query_id, id, pick (from 1).

    The best score is picked first, then whatever maximises weight * score - (1 - weight) * greatest
    word overlap with the picked. Lists are those of one query, cut to a few tens before.
    """
    importable(candidates.sparkSession)
    rows = candidates.select("query_id", "id", "score", simple_words(F.col("text")).alias("words"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True])
        sets, score = [set(w) for w in group.words], group.score.to_numpy()
        left, chosen = list(range(len(group))), []
        near = [0.0] * len(group)
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (weight * score[i] - (1 - weight) * near[i] if chosen else score[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                union = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / union if union else 0.0)
        out = group.iloc[chosen]
        return pd.DataFrame({"query_id": out.query_id, "id": out.id, "pick": range(1, len(out) + 1)})

    kind = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kind['query_id']}, id {kind['id']}, pick int")


def dedup_best(df: DataFrame, key: Column, score: str, tie: str) -> DataFrame:
    """The row of highest score for each key, ties to the smaller ``tie``."""
    order = Window.partitionBy("_key").orderBy(F.desc(score), tie)
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_key", "_r")


def confidence_label(avg_score: Column) -> Column:
    return F.when(avg_score > 0.8, "high").when(avg_score > 0.6, "medium").otherwise("low")


def gate(overlap: Column, citation: Column) -> Column:
    """pass, hedge or refuse from word overlap and citation accuracy (null: none cited)."""
    score = F.when(citation.isNull(), overlap).otherwise(0.6 * overlap + 0.4 * citation)
    return F.when(score < 0.3, "refuse").when(score < 0.5, "hedge").otherwise("pass")


def batches(f):
    """A pandas_udf over an iterator of text batches, for scoring models that are plugged in."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield f(p)

    return F.pandas_udf(run, "double")
