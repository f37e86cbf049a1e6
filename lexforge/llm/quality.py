"""Quality by compression: the text is compressed with a dictionary of good and one of bad text.

Which dictionary serves better, as a share of the size, becomes a calibrated probability. The calibration also sees
how far the text compresses by itself and how long it is, since the same difference says less of a text that
is short or repeats itself: by the difference alone the area under the curve falls from 0.995 to 0.925 (check_s).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.labelled import apply_logistic, fold, logistic, sample
from lexforge.session import cut, importable

#: Bounds of the labelled sample: rows a class, and those of each half that make its dictionaries.
SAMPLE_ROWS, DICTIONARY_ROWS = 4600, 600
#: Bytes of text a class that reach the driver for its dictionary.
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES, LEVEL = 112_640, 3


def _dictionary(texts: list[str]) -> bytes:
    raw = sorted((t.encode() for t in texts if t), key=len)
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few or too short samples: whole texts serve, short ones first
        room = np.cumsum([len(t) + 1 for t in raw])
        return b"\n".join(raw[: max(1, int(np.searchsorted(room, DICTIONARY_BYTES)))])


class Sizes:
    """Compressed sizes of a text plainly, with the good and with the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        plain = zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.coders = [plain]
        for raw in (good, bad):
            if len(raw) < 8:
                self.coders.append(plain)
                continue
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        plain, good, bad = (len(c.compress(raw)) for c in self.coders)
        base = max(good + bad, 1)
        diff, ratio = (bad - good) / base, plain / (len(raw) + 20)
        return [10 * diff, 100 * diff * abs(diff), ratio, ratio * ratio, 10 * diff * ratio, np.log1p(len(raw)) / 10]


def _within_bytes(rows: DataFrame) -> list:
    """Whole sampled texts, up to SAMPLE_BYTES a class, shorter ones first, so that the driver holds a bounded number."""
    sizes = rows.select("doc_id", "y", F.octet_length("text").alias("n")).collect()
    room, chosen = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sorted(sizes, key=lambda r: (r["n"], r["doc_id"])):
        if r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            chosen.append((r["doc_id"],))
    if not chosen:
        return []
    ids = rows.sparkSession.createDataFrame(chosen, "doc_id bigint")
    return sorted(rows.join(F.broadcast(ids), "doc_id").collect(), key=lambda r: r["doc_id"])


def train(docs: DataFrame, labels: DataFrame, keep) -> dict:
    """Two fits from labelled rows where ``keep`` holds: the sample of each class is dealt into two halves, the
    dictionaries of one half measure the other, which calibrates them, so no row calibrates what it made. With
    fewer than two rows of a class the model knows only the rate of good rows."""
    spark = docs.sparkSession
    importable(spark)
    by_class = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")  # at most SAMPLE_ROWS rows each
    rows = cut(sample(docs, labels, "quality", keep, SAMPLE_ROWS).withColumn("place", F.row_number().over(by_class)).withColumn("half", F.col("place") % 2))
    n = {y: rows.where(F.col("y") == y).count() for y in (0, 1)}
    if min(n.values()) < 2:
        return {"rate": 1.0 if n[1] > n[0] else 0.0 if n[0] > n[1] else 0.5}
    fits = []
    for half in (0, 1):
        taken = _within_bytes(rows.where((F.col("half") == half) & (F.col("place") <= 2 * DICTIONARY_ROWS)))
        made = {"good": _dictionary([r["text"] for r in taken if r["y"] == 1]), "bad": _dictionary([r["text"] for r in taken if r["y"] == 0])}

        def measure(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            sizes = Sizes(made["good"], made["bad"])
            for b in batches:
                x = [sizes.features(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

        got = rows.where(F.col("half") != half).select("y", "text").mapInArrow(measure, "y int, x array<double>").orderBy("y", "x").collect()
        fits.append(made | {"w": logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))})
    return {"fits": fits}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds score, the probability of good quality, to any table with a text column (null: empty)."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)  # four dictionaries and a few weights

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        fits = [(Sizes(f["good"], f["bad"]), f["w"]) for f in m.get("fits", [])]
        for texts in batches:
            if not fits or not len(texts):
                yield pd.Series(np.full(len(texts), m.get("rate", 0.0)))
            else:  # the mean of both
                yield pd.Series(sum(apply_logistic(w, np.array([sizes.features(t) for t in texts])) for sizes, w in fits) / len(fits))

    return docs.withColumn("score", F.pandas_udf(run, "double")("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row; rows whose fold of 3 is 1 teach nothing.

    A null or empty text is compressed as an empty one; a long text whole; repeated rows each give a row, of equal
    scores; a null doc_id is never held out; empty tables give no rows, empty labels the score 0.5. Other
    columns of either table are ignored.
    """
    model = train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
