"""Toxic passages as maximal scoring segments of token log-odds.

Token scores are log-odds between toxic and clean labelled texts under a Dirichlet prior of the pooled
counts. Words count once a distinct text, so copies and repetition lend no evidence, and words also
count by their beginnings, so that inflected forms share theirs. One linear scan finds every maximal scoring
segment. A segment of score s in a text of n words is expected k n exp(-decay s) times in clean text, the
extreme-value law: its decay is the root of the token scores' generating function, its k is fitted on clean
rows. What the law says of a text's segments is calibrated on labelled rows that did not teach the scores they
are measured by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import caches
from lexforge.llm.labelled import apply_logistic, fold, logistic, sample
from lexforge.session import cut, importable

#: Bound: labelled rows a class that teach. Every unit with evidence is kept; at a likelihood ratio of Z * Z it lies
#: in some 18 of these rows or more, so the lexicon is bounded by their words.
TEACHING_ROWS = 6_000
#: Total weight of the Dirichlet prior, in texts, and the evidence (signed root of the likelihood
#: ratio between texts with and without it) a token needs.
PRIOR, Z = 20.0, 5.0
#: Lengths of the word beginnings that count beside whole words.
STEMS = (4, 5, 6)
CACHE_LIMIT = 200_000
#: Documents of this probability or more are toxic.
THRESHOLD = 0.3
#: Score of every token without evidence; it ends a passage after a few clean words.
DRIFT = -0.5
WORD = re.compile(r"[^\W\d_]+")


def segments(at: list[int], value: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence that is ``drift`` but at ``at``.

    Candidates lie on a stack. Each links to the nearest one before it with a lower total ahead of it, and
    the search for a partner follows these links, so that every candidate is passed over once and the
    whole scan takes linear time. Only tokens of positive value open a candidate.
    """
    first: list[int] = []
    end: list[int] = []
    low: list[float] = []  # totals before and at the end of a candidate
    high: list[float] = []
    link: list[int] = []
    total, before = 0.0, 0
    for p, v in zip(at, value):
        total += drift * (p - before)
        before = p + 1
        if v <= 0:
            total += v
            continue
        start, under = p, total
        total += v
        j = len(low) - 1
        while j >= 0:
            if low[j] >= under:
                j = link[j]
            elif high[j] < total:
                start, under, back = first[j], low[j], link[j]
                del first[j:], end[j:], low[j:], high[j:], link[j:]
                j = back
            else:
                break
        first.append(start), end.append(p + 1), low.append(under), high.append(total), link.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(first, end, low, high)]


class Scores(dict):
    """Score of a word, by its strongest unit; None without evidence. Remembers a bounded number."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float | None:
        known = [u for u in (word, *(word[:n] + "*" for n in STEMS if len(word) >= n)) if u in self.lexicon]
        score = self.lexicon[max(known, key=lambda u: abs(self.lexicon[u][1]))][0] if known else None
        if len(self) > CACHE_LIMIT:
            self.clear()
        self[word] = score
        return score


def scan(text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the segments in words."""
    words = WORD.findall((text or "").lower())
    got = list(map(scores.__getitem__, words))
    at = [i for i, v in enumerate(got) if v is not None]
    return len(words), segments(at, [got[i] for i in at])


def measures(n: int, scores: list[float], model: dict) -> list[float]:
    """What a text of n words with segments of these scores, best first, shows against the law of clean texts."""
    best = scores[0] if scores else 0.0
    # log of the expected number of segments this good in a clean text of n words
    log_e = np.log(model["k"] * max(n, 1)) - model["decay"] * best
    p = -np.expm1(-np.exp(min(log_e, 50)))
    evidence = -np.log(max(p, 1e-30))
    significant = sum(s for s in scores if model["decay"] * s > np.log(model["k"] * max(n, 1)))
    second, third = (scores + [0.0, 0.0])[1:3] if scores else (0.0, 0.0)
    return [evidence / 10, min(significant, 100) / 10, best / 10, second / 10, third / 10]


def features(text: str | None, model: dict, words: Scores) -> list[float]:
    n, found = scan(text, words)
    return measures(n, sorted((s for _, _, s in found), reverse=True), model)


def _stems(words, n: int):
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def _counts(rows: DataFrame) -> DataFrame:
    """word, and the texts that hold it by half (0 or 1) and label: t0, c0, t1, c1."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    stems = [_stems(words, n) for n in STEMS]
    texts = rows.groupBy("text").agg(F.max("y").alias("y"), F.max("half").alias("half"))
    units = texts.select("y", "half", F.explode(F.array_distinct(F.concat(words, *stems))).alias("word"))
    n = lambda half, y: F.sum(((F.col("half") == half) & (F.col("y") == y)).cast("int"))
    return units.groupBy("word").agg(n(0, 1).alias("t0"), n(0, 0).alias("c0"), n(1, 1).alias("t1"), n(1, 0).alias("c1"))


def _evidence(t: Column, c: Column, n1: float, n0: float) -> tuple[Column, Column]:
    """Log-odds of a unit in t of n1 toxic and c of n0 clean texts under the prior, and its signed root likelihood ratio."""
    prior = PRIOR * (t + c) / (n1 + n0)
    a, b = t + prior, c + prior
    odds = F.log(a / (n1 + PRIOR + 1 - a)) - F.log(b / (n0 + PRIOR + 1 - b))
    rate = (t + c) / (n1 + n0)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0) + F.when((k < n) & (rate < 1), (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(0.0)
    return odds, F.signum(odds) * F.sqrt(F.greatest(2 * (part(t, n1) + part(c, n0)), F.lit(0.0)))


def _decay(values: np.ndarray, probs: np.ndarray) -> float:
    """The positive root of sum p exp(decay v) = 1, the rate of the extreme-value law."""
    if not (values > 0).any() or probs @ values >= 0:
        return 0.1
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if probs @ np.exp(np.minimum(mid * values, 500)) < 1 else (low, mid)
    return low


def train(docs: DataFrame, labels: DataFrame, keep) -> dict:
    """Lexicon, extreme-value law and calibration from labelled rows where ``keep`` holds.

    The rows are halved by a hash of their text: each half is measured by the lexicon of the other, and that is
    what the calibration learns; the model's own lexicon is that of both. Without both classes the model
    knows only the rate of toxic rows.
    """
    importable(docs.sparkSession)
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int")
    rows = cut(sample(docs, labels, "toxic", keep, TEACHING_ROWS).select("text", "y", half.alias("half")))
    counts = cut(_counts(rows))
    sizes = {(r["half"], r["y"]): float(r["n"]) for r in rows.groupBy("text").agg(F.max("y").alias("y"), F.max("half").alias("half")).groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda y, halves: sum(sizes.get((h, y), 0.0) for h in halves)
    if not n(1, (0, 1)) or not n(0, (0, 1)):
        return {"rate": 1.0 if n(1, (0, 1)) else 0.0}
    # Halves without both classes cannot teach each other; then the whole lexicon measures them.
    crossed = all(n(y, (h,)) for y in (0, 1) for h in (0, 1))
    sides = {"all": (0, 1), **({"0": (0,), "1": (1,)} if crossed else {})}
    scored = counts.select("word", (F.col("c0") + F.col("c1")).alias("clean"), *[x.alias(f"{name}_{which}") for which, halves in sides.items() for name, x in zip(("odds", "z"), _evidence(sum(F.col(f"t{h}") for h in halves), sum(F.col(f"c{h}") for h in halves), n(1, halves), n(0, halves)))])
    strong = scored.where(" or ".join(f"abs(z_{w}) >= {Z}" for w in sides)).collect()
    lexicons = {w: {r["word"]: (float(r[f"odds_{w}"]), float(r[f"z_{w}"])) for r in strong if r[f"z_{w}"] is not None and abs(r[f"z_{w}"]) >= Z} for w in sides}
    words = float(counts.where(~F.col("word").endswith("*")).agg(F.sum(F.col("c0") + F.col("c1"))).first()[0] or 1)
    seen = np.array([r["clean"] for r in strong if r["word"] in lexicons["all"]] or [0], float) / words
    values = np.append([lexicons["all"][r["word"]][0] for r in strong if r["word"] in lexicons["all"]] or [0.0], DRIFT)
    decay = _decay(values, np.append(seen, max(0.0, 1 - seen.sum())))
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("toxicity")
        by_half = [Scores(shared.value["1" if crossed else "all"]), Scores(shared.value["0" if crossed else "all"])]
        for batch in batches:
            got = [scan(t, by_half[h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            best = [sorted((s for _, _, s in found), reverse=True) for _, found in got]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([k for k, _ in got], pa.int64()), pa.array(best, pa.list_(pa.float64()))], ["y", "n", "scores"])

    got = rows.mapInArrow(measure, "y int, n bigint, scores array<double>").collect()
    clean = [r for r in got if r["y"] == 0]
    # Most likely k of a law whose best score in n words is under s with probability exp(-k n exp(-decay s)).
    expected = sum(max(r["n"], 1) * np.exp(-decay * max(r["scores"], default=0.0)) for r in clean)
    model = {"lexicon": lexicons["all"], "decay": decay, "k": float(np.clip(len(clean) / max(expected, 1e-9), 1e-6, 10.0))}
    x, y = np.array([measures(r["n"], r["scores"], model) for r in got]), np.array([r["y"] for r in got], float)
    return model | {"w": logistic(x, y)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds score, the probability that a text is toxic, to any table with a text column (null: empty); a column
    of that name is replaced (see keep_clean for one that is to stay)."""
    return docs.withColumn("score", toxic_probability(docs.sparkSession, model)("text"))


def toxic_probability(spark, model: dict):
    """A pandas UDF of text. The broadcast lexicon is bounded by the teaching rows."""
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        caches.claim("toxicity")
        m = shared.value
        words = Scores(m.get("lexicon", {}))
        for texts in batches:
            if "w" not in m:
                yield pd.Series(np.full(len(texts), m["rate"]))
            else:
                x = np.array([features(t, m, words) for t in texts]).reshape(len(texts), -1)
                yield pd.Series(apply_logistic(m["w"], x) if len(x) else np.zeros(0))

    return F.pandas_udf(run, "double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all their columns as they are, less those scored ``threshold`` or more. Null and empty texts, and
    rows without doc_id, are scored like any other; repeated rows share their fate."""
    return docs.where(toxic_probability(docs.sparkSession, model)("text") < threshold)


def passages(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, first, last (word positions, end exclusive), segment_score of every significant passage."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Scores(m.get("lexicon", {}))
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, found = scan(t, words)
                rows += [(d, a, b, s) for a, b, s in found if m["decay"] * s > np.log(m["k"] * max(n, 1))]
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()])], ["doc_id", "first", "last", "segment_score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, first bigint, last bigint, segment_score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row; rows whose fold of 4 is 2 teach nothing.

    A null or empty text is scored as one of no words; a long text whole; repeated rows each give a row, of
    equal scores; a null doc_id is never held out; empty tables give no rows, empty labels the rate 0. Other columns
    of either table are ignored.
    """
    model = train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
