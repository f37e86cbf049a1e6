"""A corpus pipeline of five stages: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns
of documents, but for the last, which returns packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import decontamination, near_dedup, packing, pii, toxicity
from lexforge.llm.labelled import fold
from lexforge.session import cut, shared_dir, table

#: SQL cannot express a trained classifier or tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go. Rows whose fold of 4 is 2 teach nothing.

    Each row is judged by its own text: null and empty texts are scored as such and stay unless the model knows only
    toxic rows; rows without doc_id, repeated rows and very long texts are scored like any other; ties at the
    threshold go. Every column stays as it is, one named score too. An empty table gives an empty one.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id, rows without one last.

    Null and empty texts are in no group and stay. Of repeated rows one stays; a doc_id that repeats with another
    text loses only the row that is a copy. Very long texts are compared whole. Every column stays as it is.
    """
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, each row judged by its own text, with or without a doc_id.

    Null and empty texts stay; repeated rows share their fate; very long texts are searched whole; benchmark items
    without text or id are in nothing, and an empty benchmark or table drops nothing. Every column stays as it is.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to the names of their kinds; n_chars, where there is one, follows the new text.

    Every row stays, null and empty texts unchanged, repeated rows each, very long texts whole; of overlapping
    spans the first names all. Other columns stay as they are.
    """
    done = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence_id and offset, in sequences of at most 2048 tokens.

    A null or empty text is one piece of its end id; very long texts give many pieces; repeated rows and rows without
    doc_id give theirs each; an empty table gives no pieces; other columns are left out.
    """
    return packing.pack(cut(packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_private),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet in the shared folder and reread."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
