"""Registered queries: answers and their evidence, hops, costs, caches, sections and training rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import legal
from lexforge.functions import text as T
from lexforge.operators import answers as A
from lexforge.operators import bm25, chunking, scoring
from lexforge.plans.retrieval import BM25_SQL, tokens_sql
from lexforge.session import shared_dir, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\r]+'), lambda w: w != '')"
COUNT_SQL = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda w: w != ''))"
PLAIN_SQL = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}')))"
#: Per conversation the words of its questions and of its answers; the latter are rated.
TALK_SQL = """talk as (select conv_id, string_agg(text, ' ' order by turn) filter (role = 'assistant') answer,
string_agg(text, ' ' order by turn) filter (role != 'assistant') sources from conversations group by 1)"""


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, answer, sources; the turns of one conversation are few."""
    said = lambda test: F.array_sort(F.collect_list(F.when(test & F.col("text").isNotNull(), F.struct("turn", "text"))))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(f"{c}.text"), " ")).alias(c)
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said(F.col("role") == "assistant").alias("answer"), said(F.col("role") != "assistant").alias("sources"))
    return g.select("conv_id", joined("answer"), joined("sources"))


_STOP = "[" + ", ".join(f"'{w}'" for w in A.STOP_WORDS) + "]"


@query(f"""with {TALK_SQL}, w as (select conv_id, list_filter({PLAIN_SQL.format('answer')}, lambda w: not list_contains({_STOP}, w)) o, {PLAIN_SQL.format('sources')} t from talk),
s as (select conv_id, case when len(t) = 0 then 0.0 when len(o) = 0 then 1.0 else len(list_intersect(o, t)) / len(o) end::double support from w)
select conv_id, round(support, 6) support, case when support < 0.3 then 'refuse' when support < 0.5 then 'hedge' else 'pass' end as action from s""")
def conf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confidence(_talk(spark, sf_dir)).select("conv_id", F.round("support", 6).alias("support"), "action")


SOURCES_SQL = """every as (select 'p' || page_id id, url, round(length(html) / (length(html) + 5000.0), 9)::double score, 'web' source_type from pages union all
select 'd' || doc_id, null, round(n_chars / (n_chars + 1000.0), 9)::double, 'documents' from documents union all
select 'd' || doc_id, '', round(0.7 * quality, 9)::double, 'feedback' from labels where quality is not null),
best as (select * exclude (r) from (select *, row_number() over (partition by coalesce(nullif(url, ''), id) order by score desc, source_type desc, id desc) r from every) where r = 1)"""


def _federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda df, i, url, score, kind: df.select(i.alias("id"), url.cast("string").alias("url"), F.round(score.cast("double"), 9).alias("score"), F.lit(kind).alias("source_type"))
    pages, docs, labels = (table(spark, sf_dir, t) for t in ("pages", "documents", "labels"))
    n, c = F.length("html"), F.col("n_chars")
    return A.federate([
        row(pages, F.concat(F.lit("p"), "page_id"), F.col("url"), n / (n + 5000.0), "web"),
        row(docs, F.concat(F.lit("d"), "doc_id"), F.lit(None), c / (c + 1000.0), "documents"),
        row(labels.where("quality is not null"), F.concat(F.lit("d"), "doc_id"), F.lit(""), 0.7 * F.col("quality"), "feedback"),
    ])


@query(f"with {SOURCES_SQL} select id, score, source_type from best order by score desc, id limit 15")
def deep_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _federated(spark, sf_dir).select("id", "score", "source_type").orderBy(F.desc("score"), "id").limit(15)


@query(f"with {SOURCES_SQL} select source_type, count(*) n from best group by 1")
def agg_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _federated(spark, sf_dir).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


HOPS_SQL = f"""h as (select conv_id query_id, row_number() over (partition by conv_id order by turn) hop,
sum(length(text)) over (partition by conv_id order by turn) / 2000.0::double completeness, (role != 'system')::int n_gaps, {COUNT_SQL.format('text')} new_words from conversations),
s as (select *, case when completeness >= 0.8 then 'complete' when n_gaps = 0 then 'no_gaps' when hop > 1 and new_words < 5 then 'little_new'
when completeness <= lag(completeness) over (partition by query_id order by hop) + 0.05 then 'plateau' end reason from h),
f as (select query_id, min(hop) filter (reason is not null) stop from s group by 1)"""


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    return A.stop_reason(c.select(
        F.col("conv_id").alias("query_id"), F.row_number().over(w).alias("hop"), (F.sum(F.length("text")).over(w) / 2000.0).alias("completeness"),
        (F.col("role") != "system").cast("int").alias("n_gaps"), T.word_count(F.col("text")).alias("new_words"),
    ), least_words=5)


@query(f"with {HOPS_SQL} select query_id, hop::int as hop, reason from s")
def multihop_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir).select("query_id", "hop", "reason")


@query(f"with {HOPS_SQL} select query_id, count(*) hops, sum(new_words)::bigint new_words from s join f using (query_id) where stop is null or hop <= stop group by 1")
def multihop_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = A.until_stop(_hops(spark, sf_dir))
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("hops"), F.sum("new_words").alias("new_words"))


_COMPLEX_SQL = " + ".join(f"contains(lower(t), '{p}')::int" for p in scoring.COMPLEX_PHRASES)


@query(f"""with c as (select conv_id, turn, coalesce(text, '') t from conversations where role = 'user')
select conv_id, turn, ({_COMPLEX_SQL}) >= 2 or {COUNT_SQL.format('t')} > 40 or length(t) - length(replace(t, '?', '')) > 1 as is_complex from c""")
def query_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", scoring.is_complex(F.coalesce("text", F.lit(""))).alias("is_complex"))


@query(f"""with {TALK_SQL}, t as (select conv_id, list_filter({tokens_sql('sources')}, lambda w: length(w) > 3) q, lower(coalesce(answer, '')) a, 0 + (answer is not null)::int k from talk)
select conv_id, round(case when len(q) = 0 then k / 3.0 else 0.7 * len(list_filter(q, lambda w: contains(a, w))) / len(q) + 0.3 * k / 3.0 end::double, 6) score from t""")
def evid_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(F.array("answer"))
    return _talk(spark, sf_dir).select("conv_id", F.round(scoring.evidence_heuristic(evidence, F.col("sources")), 6).alias("score"))


@query("""with s as (select source, avg(quality)::double pa, 1.0 - avg(toxic)::double fc, least(1.0, count(*) / 100.0)::double es from documents join labels using (doc_id) group by 1)
select source, round(0.35 * coalesce(pa, 0.5) + 0.25 * coalesce(fc, 0.5) + 0.25 * 0.5 + 0.15 * es, 6) reward from s""")
def reward_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's four scores weighted; one that is not given counts a half."""
    rated = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    scores = F.create_map(F.lit("precedent_alignment"), F.avg("quality"), F.lit("factor_completeness"), 1.0 - F.avg("toxic"), F.lit("evidence_strength"), F.least(F.lit(1.0), F.count(F.lit(1)) / 100.0))
    m = rated.groupBy("source").agg(scores.alias("m"))
    return m.select("source", F.round(A.reward(F.col("m"), A.REWARD_WEIGHTS), 6).alias("reward"))


@query(f"""with {TALK_SQL}, n as (select conv_id, {COUNT_SQL.format('sources')} i, {COUNT_SQL.format('answer')} o from talk)
select conv_id, round(i / 1000 * 0.00002::double + (i + o) / 1000 * 0.000075::double, 9) cost from n""")
def agg_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_in, n_out = (T.word_count(F.col(c)) for c in ("sources", "answer"))
    return _talk(spark, sf_dir).select("conv_id", F.round(A.cost(n_in, n_out), 9).alias("cost"))


@query(f"""with n as (select doc_id, {COUNT_SQL.format('text')} n from documents)
select doc_id, round(case when n > 500 then least(1.0, 600.0 / n) else 1.0 end::double, 6) penalty from n""")
def length_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(A.length_penalty(F.col("text")), 6).alias("penalty"))


@query(f"""with w as (select conv_id, turn, {WORDS_SQL.format('text')} w from conversations where role = 'assistant'),
e as (select conv_id, turn, w, unnest(generate_series(0, len(w) - 1, 3)) i from w)
select conv_id, turn, (i // 3)::int as event, array_to_string(w[i + 1:i + 3], ' ') content from e""")
def sse_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return told.select("conv_id", "turn", F.posexplode(A.events_of(F.col("text"))).alias("event", "content"))


@query("""with c as (select doc_id, nullif(source, 'src0') source from documents),
m as (select source mode from c where source is not null group by 1 order by count(*) desc, 1 limit 1)
select doc_id, coalesce(source, (select mode from m), 'Unknown') source from c""")
def agg_mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("source"))
    return A.impute_mode(docs, "source")


@query("""with l as (select quality y, 1 - toxic p from labels where quality is not null), t as (select y, count(*) support, sum((p = y)::int) tp from l group by 1),
s as (select p y, count(*) said from l group by 1),
m as (select support, tp, coalesce(tp / said, 0) pr, tp / support re from t left join s using (y)),
f as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end f from m)
select round(sum(tp) / sum(support), 6) accuracy, round(sum(pr * support) / sum(support), 6) "precision", round(sum(re * support) / sum(support), 6) recall, round(sum(f * support) / sum(support), 6) f1 from f""")
def agg_ml_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("p"))
    return A.ml_metrics(rows, "quality", "p").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("""with l as (select user_id, max(ts) t from events group by 1), r as (select *, row_number() over (order by t desc, user_id) r from l)
select user_id, r > 100 as evicted from r""")
def win_lru_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.least_recent(table(spark, sf_dir, "events"), "user_id", 100).select("user_id", "evicted")


@query(f"select query_id, id, rank, score, total from (select *, count(*) over (partition by query_id) total from ({BM25_SQL})) where rank between 6 and 10")
def sort_page_after_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five results of every query, and how many were fetched for it."""
    found = bm25.search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 10)
    held = found.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))  # ten rows a query
    return held.where("rank between 6 and 10").select("query_id", "id", "rank", F.round("score", 6).alias("score"), "total")


@query("""select doc_id, left(md5(coalesce(text, '')), 12) short_id, left(sha256(coalesce(text, '')), 16) cache_key,
regexp_replace('doc_' || doc_id || '_chunk' || n_chars, '_chunk[0-9]+$', '') parent_id from documents""")
def proj_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    chunk = F.concat(F.lit("doc_"), "doc_id", F.lit("_chunk"), "n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5(text), 1, 12).alias("short_id"), F.substring(F.sha2(text, 256), 1, 16).alias("cache_key"), F.regexp_replace(chunk, "_chunk[0-9]+$", "").alias("parent_id"))


TRAIN_SQL = f"with {TALK_SQL} select conv_id, sources instruction, answer as output from talk where answer is not null and sources is not null"


def _train_jsonl(rows: DataFrame) -> DataFrame:
    """conv_id, sources and answer as JSON lines of instruction, input and output, written and read back."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/train_jsonl/{uuid.uuid4().hex}"
    rows.select("conv_id", F.col("sources").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output")).write.json(path)
    return spark.read.schema("conv_id bigint, instruction string, input string, output string").json(path).drop("input")


@query(TRAIN_SQL)
def sink_train_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answered conversation, rated or not, as a training row."""
    return _train_jsonl(_talk(spark, sf_dir).where("answer is not null and sources is not null"))


@query(f"{TRAIN_SQL} and conv_id in (select doc_id from labels where quality = 1 and toxic = 0)")
def sink_train_useful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows of feedback: answered conversations rated useful (labels of their number)."""
    useful = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("conv_id"))
    return _train_jsonl(_talk(spark, sf_dir).where("answer is not null and sources is not null").join(useful, "conv_id", "left_semi"))


@query("""with l as (select conv_id, turn, unnest(string_split(regexp_replace(coalesce(text, ''), '\\. ', chr(10) || '2) ', 'g') || '?', chr(10))) s from conversations where role = 'user'),
t as (select conv_id, turn, regexp_replace(trim(s), '^(\\d+[.)]|[-*•])\\s*', '') s from l), k as (select conv_id, turn, count(*) filter (s like '%?') n from t group by all)
select conv_id, turn, least(n, 5)::int n from k""")
def text_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions a turn asks when its sentences are numbered lines and the last is a question."""
    said = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", "\n2) "), F.lit("?"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.size(legal.follow_ups(said)).alias("n"))


@query(f"""with r as (select query_id, id, rank, text, source from ({BM25_SQL}) join documents on doc_id = id where rank <= 3)
select query_id, string_agg('[Source ' || rank || '] ' || coalesce(source, 'Unknown') || chr(10) || left(coalesce(text, ''), 300), chr(10) || chr(10) order by rank) block from r group by 1""")
def text_source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of every item as the block of sources of a prompt."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(spread(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 3)
    rows = bm25.with_fields(found, docs.select(F.col("doc_id").alias("id"), "text", "source"))
    return A.source_block(rows, ["query_id"], F.col("rank"), F.col("source"), F.col("text"))


@query()
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_sections(table(spark, sf_dir, "documents"))
