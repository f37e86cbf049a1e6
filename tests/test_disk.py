"""What queries write and shuffle, and ties that float noise must not decide."""

import os

import pytest
from pyspark.sql import functions as F

from lexforge import registry
from lexforge.operators import bm25, bm25_index, ranking

SF = "/root/testdata/sf0.01"
#: Times the documents' size that a query may shuffle and write.
TIMES = {
    "bm25_stored": 12,
    "bm25_stored_stats": 8,
    "hybrid_mmr": 10,
    "keyword_boost": 2,
    "mmr_pair": 6,
    "proj_format_sources": 2,
    "rerank_apply": 1,
    "text_source_block": 2,
}


def written(spark, since=-1):
    """The last stage, and the bytes that stages after ``since`` shuffled and wrote."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    lists = [jvm.java.util.ArrayList() for _ in range(2)]
    found = store.stageList(lists[0], False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), lists[1])
    stages = [found.apply(i) for i in range(found.size())]
    return max((x.stageId() for x in stages), default=-1), sum(x.shuffleWriteBytes() + x.outputBytes() for x in stages if x.stageId() > since)


@pytest.mark.parametrize("name", sorted(TIMES))
def test_disk(spark, name):
    """Whole tables are not broadcast, as larger ones could not be."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    last = written(spark)[0]
    try:
        registry.QUERIES[name](spark, SF).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written(spark, last)[1] < TIMES[name] * os.path.getsize(f"{SF}/documents.parquet")


def test_copies_keep_their_positions(spark):
    """Scores that differ in their last digits alone are ties."""
    results = spark.createDataFrame([(1, p, 100 + p, s) for p, s in enumerate([2.1, 2.0999999999999996, 2.1000000000000005, 0.5])], "query_id int, pos int, id int, score double")
    fresh = spark.createDataFrame([(1, 3, 9.0)], "query_id int, pos int, new_score double")
    assert [r.id for r in ranking.rerank(results, fresh, 4).orderBy("rank").collect()] == [103, 100, 101, 102]


def test_ids_that_repeat_count_as_one_document(spark, monkeypatch):
    """Of equal length they are merged; of other lengths their scores are added; null is an id."""
    rows = [(1, "a b c"), (1, "a x y"), (1, "a a b b c"), (2, "a b"), (None, "a c"), (None, "b c"), (3, "z z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "z"), (None, "c")], "item_id bigint, text string")
    found = lambda k: sorted(((r.query_id or 0, r["rank"], r.id or 0, round(r.score, 9)) for r in bm25.search(docs, asked, k).collect()))
    got = found(2), found(9)
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", -1)
    assert got == (found(2), found(9)) and len(got[1]) > len(got[0])


def test_a_stored_index_brings_rows_of_an_id_together(spark, tmp_path, monkeypatch):
    """Whatever tasks they lie in, and where ranges are shorter than the rows of an id."""
    monkeypatch.setattr(bm25_index, "RANGE_DOCS", 2)
    rows = [(1, "a b c"), (1, "a x y"), (1, "a a b b c"), (2, "a b"), (None, "a c"), (None, "b c"), (3, "z z"), (4, None), (5, "a"), (6, "b a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    asked = spark.createDataFrame([(1, "a b"), (2, "z"), (3, "c a"), (4, "nowhere")], "item_id bigint, text string")
    index = bm25_index.build(docs, str(tmp_path / "i"))
    found = lambda hits: sorted((r.query_id or 0, r["rank"], r.id or 0, round(r.score, 9)) for r in hits.collect())
    assert found(bm25_index.search(index, asked, 3).hits) == found(bm25.search(docs, asked, 3))
    assert index.corpus().first()["n"] == len(rows)
    want = found(bm25_index.search(index, asked, 2).hits)
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 2)
    assert found(bm25_index.search(index, asked, 2).hits) == want


def test_hops_look_words_up_without_a_shuffle_of_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id bigint, text string")
    index = bm25_index.build(docs, str(tmp_path / "i"))
    pairs = index.documents.select(F.lit(7).alias("query_id"), "id", "range", F.lit("beta").alias("term"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = bm25_index.holding(index, pairs)
        assert sorted(r.id for r in held.collect()) == [1, 2]
        assert "SortMergeJoin" not in held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
