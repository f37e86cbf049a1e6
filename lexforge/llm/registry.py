"""The queries of this package, each over its whole tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import alignment, decontamination, filter_audit, near_dedup, packing, pii, quality, secrets, sharding, token_files, toxicity, url_rules, vector_topk
from lexforge.llm.oracles import ORACLES  # noqa: F401
from lexforge.session import cut, shared_dir, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packing.pack(cut(pieces))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(vector_topk.quantised(table(spark, sf_dir, "embeddings")))
    return vector_topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "k1", "k2")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: The rules of op13: host, path and verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = url_rules.build(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), array).drop("url")


_ALL = (op1_token_files, op2_packing, op3_topk, op4_decontamination, op5_quality, op6_toxicity, op7_secrets, op8_sharding, op9_pii, op10_near_dedup, op11_alignment, op12_filter_audit, op13_url_rules)
QUERIES = {f.__name__: f for f in _ALL}
