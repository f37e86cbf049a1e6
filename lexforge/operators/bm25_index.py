"""A stored inverted index: built once, added to, searched often without reading a text again.

Documents are cut into ranges of ``RANGE_DOCS`` where they lie, so that no text is shuffled; a block holds the postings of
one term in one range. Its head has the least length for each count of the term (its peaks), which give the most any of its
documents can score for the term, whatever the mean length has become. A search reads the heads of its terms, scores the
``k`` most promising ranges of each query, and leaves out every range whose bound is under the k-th score found there: the
ranks are those of a full search. Postings lie in folders by hashed term, lists of documents in one beside them. A range
is scored at once for all queries that read it (``postings``), and hands on what reaches their bars.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import lower_tokens
from lexforge.operators import bm25, postings
from lexforge.operators.bm25 import B, K1, query_terms, top_k
from lexforge.session import cut, importable

RANGE_DOCS, BUCKETS = 256, 32
#: Pairs of a term and a range, or of a term and a document, that are broadcast at most, some 50 MB.
BROADCAST_PAIRS = 500_000


@dataclass(frozen=True)
class StoredIndex:
    """Where an index lies: a Parquet folder with ``documents(id, range, dl, content)``, a list a range, and ``blocks``."""

    spark: SparkSession
    path: str

    @property
    def documents(self) -> DataFrame:
        lists = self.spark.read.parquet(f"{self.path}/blocks").where("bucket = -1")
        rows = lists.select("range", F.explode(F.arrays_zip("ids", "dls", "contents")).alias("d"))
        return rows.select(F.col("d.ids").alias("id"), "range", F.col("d.dls").cast("bigint").alias("dl"), F.col("d.contents").alias("content"))

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks").where("bucket >= 0").drop("contents")

    def corpus(self) -> DataFrame:
        """One row: n and avgdl."""
        return self.documents.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _share(tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(F.col("avgdl"), F.lit(1.0))))


def _blocks(segment: int, most: int, whole: bool):
    """For mapInArrow: ``id, tokens, content`` to the blocks of ranges of ``most`` documents and their lists.

    ``whole``: rows come in order of ids that repeat; those of one id stay in one range, and equal lengths are one posting.
    """

    def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    def one(rows: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(rows)
        ids, tokens, content = (held[c].combine_chunks() for c in ("id", "tokens", "content"))
        dl, words = postings.flat(tokens)
        unit, times = np.arange(len(dl)), 1
        if whole:
            seen: dict = {}
            unit = np.array([seen.setdefault(x, i) for i, x in enumerate(zip(ids.to_pylist(), dl.tolist()))])
            times = max(Counter(i for i, _ in seen).values())  # postings of one id add up, and so may their bounds
        coded = words.dictionary_encode()
        key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(dl) + np.repeat(unit, dl), return_counts=True)
        term, doc = np.divmod(key, len(dl))
        every = np.arange(len(coded.dictionary) + 1)
        at = np.searchsorted(term, every)
        # Of each count of a term the least length.
        order = np.lexsort((dl[doc], tf, term))
        peak = order[np.flatnonzero(np.diff(term[order], prepend=-1) | np.diff(tf[order], prepend=-1))]
        pair = pa.StructArray.from_arrays([pa.array(tf[peak], pa.int32()), pa.array(dl[doc[peak]], pa.int32())], ["tf", "dl"])
        none, n = lambda kind, n: pa.nulls(n, kind), len(coded.dictionary)
        names = ["term", "range", "n", "peaks", "ids", "tfs", "dls", "contents", "times"]
        blocks = [
            coded.dictionary, pa.array(np.full(n, number)), pa.array(np.diff(at)), lists(np.searchsorted(term[peak], every), pair), lists(at, ids.take(pa.array(doc))),
            lists(at, pa.array(tf, pa.int32())), lists(at, pa.array(dl[doc], pa.int32())), none(pa.list_(content.type), n),
            pa.array(np.full(n, times), pa.int32()),
        ]
        all_ = np.array([0, len(dl)])
        docs = [none(coded.dictionary.type, 1), pa.array([number]), pa.array([len(dl)]), none(blocks[3].type, 1), lists(all_, ids), none(blocks[5].type, 1), lists(all_, pa.array(dl, pa.int32())), lists(all_, content), none(pa.int32(), 1)]
        yield pa.RecordBatch.from_arrays(docs, names)
        if n:
            yield pa.RecordBatch.from_arrays(blocks, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (segment << 36) + (TaskContext.get().partitionId() << 16)
        rows, held, last = [], 0, None
        for b in batches:
            ids, at = b.column("id").to_pylist() if whole else [], 0
            for i in range(b.num_rows):
                if held >= most and not (whole and ids[i] == last):
                    rows.append(b.slice(at, i - at))
                    yield from one(rows, number)
                    rows, held, at, number = [], 0, i, number + 1
                held, last = held + 1, ids[i] if whole else None
            rows.append(b.slice(at))
        if held:
            yield from one(rows, number)

    return run


def add(index: StoredIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> StoredIndex:
    """Append documents with new ids; blocks that are there stay as they are.

    A null text is an empty document. Texts are counted where they lie, but for rows whose id repeats or is null, which
    are brought together; every task writes its blocks to their folders, so nothing is shuffled, and a block has at most a
    range's documents, whatever the term. Statistics are sums over heads and lengths, so nothing else changes.
    """
    importable(docs.sparkSession)
    segment = uuid.uuid4().int >> 103  # 25 bits: ranges of one batch are apart from those of others
    named = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = dict(named.dtypes)["id"]
    rows = named.select("id", lower_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("content"))
    form = f"term string, range bigint, n bigint, peaks array<struct<tf: int, dl: int>>, ids array<{kind}>, tfs array<int>, dls array<int>, contents array<string>, times int"
    again = cut(named.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("again")))
    if again.isEmpty():
        blocks = rows.mapInArrow(_blocks(2 * segment, RANGE_DOCS, False), form)
    else:
        again = F.broadcast(again) if again.count() <= BROADCAST_PAIRS else again
        same = F.col("id").eqNullSafe(F.col("again"))
        apart, together = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi").repartition("id").sortWithinPartitions("id")
        blocks = apart.mapInArrow(_blocks(2 * segment, RANGE_DOCS, False), form).union(together.mapInArrow(_blocks(2 * segment + 1, RANGE_DOCS, True), form))
    placed = blocks.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term"))))
    placed.sortWithinPartitions("bucket", "term", "range").write.mode("append").partitionBy("bucket").parquet(f"{index.path}/blocks")
    return index


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> StoredIndex:
    """A new index of ``docs`` under ``path``."""
    return add(StoredIndex(docs.sparkSession, path), docs, doc_id, text)


@dataclass(frozen=True)
class Found:
    """``hits(query_id, id, range, score, rank)`` and ``work(query_id, blocks, read)``: blocks of a query's terms, and
    those whose postings it read."""

    hits: DataFrame
    work: DataFrame


def _near(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """The blocks of ``terms(term)``; other buckets are not read, and no block is shuffled."""
    buckets = [r[0] for r in terms.select(_bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
    return index.blocks.where(F.col("bucket").isin(buckets)).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


def heads(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """term, range, n, peaks and times (postings of one document at most) of the blocks of ``terms(term)``, up to ``bm25.BROADCAST_TERMS``; postings are not read."""
    return _near(index, terms).select("term", "range", "n", "peaks", "times", "bucket")


def search(index: StoredIndex, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text") -> Found:
    """The k best documents of each query, as ``bm25.search`` ranks them; null or unknown words ask for nothing.

    Queries with more than ``bm25.BROADCAST_TERMS`` words in all are searched in turns.
    """
    importable(index.spark)
    asked = cut(query_terms(queries, query_id, text))
    turns = max(1, math.ceil(asked.count() / max(1, bm25.BROADCAST_TERMS)))
    deal = F.pmod(F.xxhash64("query_id"), F.lit(turns))
    found = [_search(index, asked.where(deal == i) if turns > 1 else asked, k) for i in range(turns)]
    hits, work = found[0].hits, found[0].work
    for f in found[1:]:
        hits, work = hits.unionByName(f.hits), work.unionByName(f.work)
    return Found(hits, work)


def _scored(weights: postings.Weights, k: int):
    """For cogrouped ``term, range, ids, tfs, dls`` and ``query_id, range, bar`` of one range: query_id, id, range, score of
    the documents that reach a query's bar and are among its ``k`` best there (or tie with them)."""

    def run(blocks: pa.Table, some: pa.Table) -> pa.Table:
        asked, number = some["query_id"].combine_chunks(), some["range"].combine_chunks()
        query = pc.index_in(asked, value_set=weights.queries).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = [pa.table({"query_id": asked.slice(0, 0), "id": blocks["ids"].combine_chunks().flatten().slice(0, 0), "range": number.slice(0, 0), "score": pa.array([], pa.float64())})]
        if blocks.num_rows and some.num_rows:
            code = pc.index_in(blocks["term"].combine_chunks(), value_set=weights.terms).to_numpy(zero_copy_only=False).astype(np.int64)
            size, ids = postings.flat(blocks["ids"].combine_chunks())
            tf, dl = (blocks[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("tfs", "dls"))
            ids = ids.dictionary_encode(null_encoding="encode")
            doc, term = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(code, size)
            bar = some["bar"].to_numpy()
            for at in range(0, len(ids.dictionary), weights.at_once()):
                n = min(weights.at_once(), len(ids.dictionary) - at)
                own = (doc >= at) & (doc < at + n)
                scores = weights.scores(n, doc[own] - at, term[own], tf[own], dl[own])[:, query]
                least = np.maximum(bar, np.partition(scores, n - k, axis=0)[n - k]) if n > k else bar
                d, q = np.nonzero((scores > 0) & (scores >= least - postings.SLACK))
                out.append(pa.table({"query_id": asked.take(pa.array(q)), "id": ids.dictionary.take(pa.array(d + at)), "range": number.take(pa.array(q)), "score": scores[d, q]}))
        return pa.concat_tables(out)

    return run


def _search(index: StoredIndex, asked: DataFrame, k: int) -> Found:
    corpus = index.corpus().first()
    counts = cut(heads(index, asked).groupBy("term").agg(F.sum("n").alias("df")))  # a row a term
    weights = postings.Weights.of(asked.toArrow(), counts.toArrow(), corpus["n"], corpus["avgdl"])
    idf = F.log((F.lit(corpus["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = F.broadcast(cut(asked.join(counts, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"))))
    most = F.array_max(F.transform("peaks", lambda x: _share(x.tf, x.dl)))
    tops = heads(index, asked).withColumn("avgdl", F.lit(corpus["avgdl"])).select("term", "range", (F.col("times") * most).alias("most"))
    ranges = tops.join(weighed, "term").groupBy("query_id", "range").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    ranges = cut(ranges.withColumn("first", first))

    def score(some: DataFrame) -> DataFrame:
        near = _near(index, asked).select("term", "range", "ids", "tfs", "dls")
        need = some.join(weighed, "query_id").select("term", "range").distinct()
        if need.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
            near = near.join(F.broadcast(need), ["term", "range"], "left_semi")
        kinds = dict(some.dtypes) | dict(index.documents.dtypes)
        return near.groupBy("range").cogroup(some.groupBy("range")).applyInArrow(_scored(weights, k), f"query_id {kinds['query_id']}, id {kinds['id']}, range bigint, score double")

    seeds = cut(score(ranges.where(F.col("first") <= k).select("query_id", "range", F.lit(0.0).alias("bar"))))
    bars = top_k(seeds, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("bar")).where(F.col("found") >= k)
    open_ = ranges.where(F.col("first") > k).join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 1e-8))
    open_ = cut(open_.select("query_id", "range", "blocks", F.coalesce("bar", F.lit(0.0)).alias("bar")))
    hits = cut(top_k(seeds.unionByName(score(open_.select("query_id", "range", "bar"))), k))
    read = ranges.where(F.col("first") <= k).select("query_id", "blocks").unionByName(open_.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    work = ranges.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id")
    return Found(hits, work)


def holding(index: StoredIndex, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(id, range, term, ...)`` whose document holds the term; up to ``BROADCAST_PAIRS`` go to the blocks,
    beyond that the blocks of their terms are shuffled."""
    pairs = cut(pairs)
    blocks = _near(index, pairs.select("term")).select("term", "range", "ids")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    return blocks.join(F.broadcast(pairs) if few else pairs, ["term", "range"]).where(F.array_contains("ids", F.col("id"))).select(*pairs.columns)
