"""Labelled rows for the classifiers, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """text and y of at most ``per_class`` labelled rows a class, chosen by a hash of doc_id.

    Only the chosen ids are joined, at most ``2 * per_class`` of them, so they may be broadcast
    and no other text is shuffled. Null ids, texts and labels are left out; a doc_id that repeats gives
    one row, with its least text.
    """
    ids = labels.where(keep & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    ids = ids.where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    by_class = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = by_class[0].unionByName(by_class[1])
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method with step halving; the last weight is the intercept.

    The ridge and the halving keep weights finite where the classes part cleanly. Columns of x should
    be near unit scale.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    n, w = np.ones(len(x)) if weight is None else weight, np.zeros(x.shape[1])
    cost = lambda v: n @ np.logaddexp(0, x @ v) - (n * y) @ (x @ v) + ridge * (v @ v) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and cost(w - size * step) > cost(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
