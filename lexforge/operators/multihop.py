"""Retrieval in hops for many questions at once: search, see what is missing, ask for that, until a reason to stop.

A hop is one search of a stored index for all questions that go on. Evidence is known by the hash of its content; a copy
adds nothing. What a question still lacks and how complete its evidence is come from ``gaps``, which may be replaced: by
default the words of the question that no evidence holds. Each hop's tables are materialised, so plans do not grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import lower_tokens
from lexforge.operators import bm25_index
from lexforge.operators.answers import stop_reason
from lexforge.operators.bm25 import with_fields
from lexforge.session import cut


@dataclass(frozen=True)
class Hops:
    """``evidence(query_id, hop, id, content)``, each content once a question, and ``hops(query_id, hop, query,
    completeness, n_gaps, new_words, reason)``; reason is null where the question went on."""

    evidence: DataFrame
    hops: DataFrame


def word_gaps(index: bm25_index.StoredIndex, questions: DataFrame, evidence: DataFrame, width: int) -> DataFrame:
    """query_id, completeness, n_gaps, next: the words of ``questions(query_id, q)`` over three signs that no evidence
    holds, and the first ``width`` of them as the next query."""
    place = F.posexplode(F.array_distinct(F.filter(lower_tokens(F.col("q")), lambda w: F.length(w) > 3))).alias("at", "term")
    words = cut(questions.select("query_id", place))
    pairs = words.join(evidence.select("query_id", "id", "range"), "query_id")
    met = bm25_index.holding(index, pairs).select("query_id", "term").distinct().withColumn("met", F.lit(True))
    seen = words.join(met, ["query_id", "term"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("met").isNull(), F.struct("at", "term"))))
    told = seen.groupBy("query_id").agg((F.count("met") / F.count(F.lit(1))).alias("completeness"), missing.alias("m"))
    return told.select("query_id", "completeness", F.size("m").cast("bigint").alias("n_gaps"), F.array_join(F.transform(F.slice("m", 1, width), lambda x: x.term), " ").alias("next"))


def retrieve(index: bm25_index.StoredIndex, questions: DataFrame, k: int = 3, most_hops: int = 5, width: int = 4, gaps: Callable | None = None) -> Hops:
    """Hops of ``questions(query_id, q)``: ``k`` documents each, at most ``most_hops``.

    A question stops when its evidence is complete, nothing is missing, a hop adds little or changes little
    (``stop_reason``), or when a search finds nothing. Questions without words stop at once without a hop.
    """
    questions = cut(questions.select("query_id", "q"))
    going = questions.select("query_id", F.col("q").alias("query"))
    evidence = hops = None
    for hop in range(1, most_hops + 1):
        hits = bm25_index.search(index, going, k, "query_id", "query").hits
        hits = cut(with_fields(hits, index.documents.select("id", "dl", "content")))
        # Of copies found together the best ranked stays.
        new = hits.groupBy("query_id", "content").agg(F.min_by(F.struct("id", "range", "dl", "rank"), "rank").alias("r")).select("query_id", "content", "r.*")
        if evidence is not None:
            new = new.join(evidence, ["query_id", "content"], "left_anti")
        new = cut(new.select("query_id", F.lit(hop).alias("hop"), "id", "range", "content", "dl"))
        found = hits.select("query_id").distinct()
        evidence = new if evidence is None else cut(evidence.unionByName(new))
        told = (gaps or word_gaps)(index, questions.join(found, "query_id", "left_semi"), evidence, width)
        added = new.groupBy("query_id").agg(F.sum("dl").alias("new_words"))
        row = going.join(told, "query_id").join(added, "query_id", "left").select("query_id", F.lit(hop).alias("hop"), "query", "completeness", "n_gaps", F.coalesce("new_words", F.lit(0)).alias("new_words"), "next")
        hops = cut(row if hops is None else hops.unionByName(row))
        judged = stop_reason(hops).where((F.col("hop") == hop) & F.col("reason").isNull())
        going = cut(judged.select("query_id", F.col("next").alias("query")))
        if going.isEmpty():
            break
    return Hops(evidence.select("query_id", "hop", "id", "content"), stop_reason(hops).drop("next"))
