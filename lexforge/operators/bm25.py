"""Inverted index and BM25 ranking as joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import lower_tokens
from lexforge.operators import postings
from lexforge.operators.postings import B, K1
from lexforge.session import cut, importable, written

#: Words of queries, counted for each query, that every task gets, some 64 MB; more are joined by shuffling.
BROADCAST_TERMS = 1_000_000
#: Hits that are broadcast at most, some 20 MB.
BROADCAST_HITS = 250_000


@dataclass(frozen=True)
class Index:
    """postings(id, term, tf, dl), terms(term, df, idf) and one row of corpus(n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """Tokenise, count and weigh. Null texts are empty documents; they count in n and avgdl."""
    tokens = docs.select(F.col(id_col).alias("id"), lower_tokens(F.col(text_col)).alias("tokens"))
    sized = tokens.select("id", "tokens", F.size("tokens").alias("dl"))
    corpus = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = sized.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Documents are counted by their distinct words, without the postings.
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = df.join(F.broadcast(corpus), how="cross").select("term", "df", idf.alias("idf"))  # corpus is one row
    return Index(postings.select("id", "term", "tf", "dl"), terms, corpus)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, term, qtf: repeated words weigh as often as they occur."""
    words = queries.select(F.col(id_col).alias("query_id"), F.explode(lower_tokens(F.col(text_col))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best documents a query; scores of 0 or less are left out.

    Texts are tokenised once, in place, and kept as numbers of the queries' terms with their counts (``postings``); no
    word is shuffled. A task scores its documents for all queries and hands on the k best of each, so what is shuffled
    grows with tasks and queries, not with their product with the documents. Rows that share an id, or have none, count as
    one document and are brought together first. More than ``BROADCAST_TERMS`` words of queries are joined by shuffling.
    ``allowed`` (a table of ids) restricts what is ranked, not the statistics.
    """
    q = cut(query_terms(queries, query_id, text_col))
    sized = docs.select(F.col(doc_id).alias("id"), lower_tokens(F.col(text_col)).alias("tokens"))
    if q.count() > BROADCAST_TERMS:
        return _search_by_shuffle(sized, q, k, allowed)
    importable(docs.sparkSession)
    asked = q.toArrow()
    kind = dict(sized.dtypes)["id"]
    terms = asked["term"].combine_chunks().unique()
    packed = written(sized.mapInArrow(postings.pack(terms), f"id {kind}, dl bigint, terms array<int>, tfs array<int>"))
    n, total = packed.agg(F.count(F.lit(1)), F.sum("dl")).first()
    rows = packed.select("id", "terms", "tfs", F.array_repeat("dl", F.size("terms")).alias("dls"))
    again = cut(packed.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("again")))
    if not again.isEmpty():
        entries = packed.join(again, F.col("id").eqNullSafe(F.col("again"))).select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        entries = entries.groupBy("id", "dl", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").cast("int").alias("tf"))
        whole = entries.groupBy("id").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("p")).select("id", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
        rows = written(rows.join(again, F.col("id").eqNullSafe(F.col("again")), "left_anti").unionByName(whole))
    df = rows.select(F.explode("terms").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row a term
    known = pa.table({"term": terms.take(df["at"].combine_chunks()), "df": df["df"]})
    weights = postings.Weights.of(asked, known, n, total / n if n else 0.0)
    if allowed is not None:
        rows = rows.join(allowed, "id", "left_semi")
    found = rows.mapInArrow(postings.best(weights, k), f"query_id {dict(q.dtypes)['query_id']}, id {kind}, score double")
    return cut(top_k(found, k))


def _search_by_shuffle(sized: DataFrame, q: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """``search`` for any number of queries: words and scores of all pairs are shuffled."""
    wanted = q.select("term").distinct()
    counted = sized.select(F.size("tokens").alias("dl"))
    words = sized.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    held = cut(words.join(wanted, "term", "left_semi"))
    corpus = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if allowed is not None:
        held = held.join(allowed, "id", "left_semi")
    weights = q.join(df, "term").join(F.broadcast(corpus), how="cross")
    weights = weights.select("query_id", "term", "avgdl", (F.col("qtf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    scores = held.join(weights, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * share).alias("score"))
    return cut(top_k(scores.where("score > 0"), k))


def with_fields(hits: DataFrame, docs: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """``hits`` joined with the rows of ``docs`` of the same ``key``, texts of other documents not shuffled.

    Up to ``BROADCAST_HITS`` hits are broadcast, so that only documents that were found leave their task;
    ``hits`` should be materialised.
    """
    few = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    if few and how == "inner":
        return docs.join(F.broadcast(hits), key).select(*hits.columns, *[c for c in docs.columns if c != key])
    found = docs.join(F.broadcast(hits.select(key).distinct()), key, "left_semi") if few else docs
    return hits.join(found, key, how)


def field_scores(docs: DataFrame, queries: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, id and a BM25 score a field (0 where nothing matches) of every document that matches in some field.

    ``docs(id, <field> array<array<string>>, ...)`` has the words of a field by place, with all words that stand for them, and
    ``queries(query_id, words)`` what is asked. Lengths count places. Fields are scored side by side in one aggregate and
    nothing is cut.
    """
    asked = queries.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    side = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.array().cast("array<array<string>>")).alias("places")) for f in fields]
    rows = docs.select("id", F.explode(F.array(*side)).alias("f")).select("id", "f.field", F.size("f.places").alias("dl"), F.flatten("f.places").alias("words"))
    corpus = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # a row a field
    words = rows.select("id", "field", "dl", F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = cut(words.groupBy("field", "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").join(F.broadcast(corpus), "field")
    weights = weights.select("query_id", "field", "term", "avgdl", (F.col("qtf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    return tf.join(weights, ["field", "term"]).groupBy("query_id", "id").agg(*[F.sum(F.when(F.col("field") == f, part).otherwise(0.0)).alias(f) for f in fields])


def all_words(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id of ``docs(id, words)`` that hold every word of ``queries(query_id, words)``, the k smallest ids each.

    Candidates of a query are the documents with its rarest word; only those are compared with all its words. A query
    without words, or with one that no document has, finds nothing.
    """
    asked = cut(queries.select("query_id", F.array_distinct("words").alias("asked")).where("size(asked) > 0"))
    terms = asked.select("query_id", F.explode("asked").alias("term"))
    held = docs.select("id", F.explode(F.array_distinct("words")).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    held = cut(held)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = terms.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).where("r.df > 0").select("query_id", "r.term")
    near = held.join(rare, "term").select("query_id", "id").join(asked, "query_id")
    sure = near.join(docs.select("id", "words"), "id").where(F.size(F.array_except("asked", "words")) == 0)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return sure.select("query_id", "id").distinct().withColumn("r", r).where(F.col("r") <= k).drop("r")


def top_k(scores: DataFrame, k: int, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """The k best rows of each query, ties to the smaller id. Scores are compared at 9 decimals."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
