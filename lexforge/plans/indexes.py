"""Registered queries over stored indexes: word search without texts, hops of retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import bm25_index, multihop
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


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


@query(BM25_SQL)
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every item from a stored index, built of two batches."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    index = bm25_index.build(docs.where("doc_id % 2 = 0"), _path(spark, "bm25"))
    bm25_index.add(index, docs.where("doc_id % 2 != 0"))
    return bm25_index.search(index, table(spark, sf_dir, "benchmark"), 10).hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""with d as (select doc_id id, {tokens_sql('text')} ws from documents), t as (select distinct id, unnest(ws) term from d),
p as (select term, count(*) n from t group by 1) select count(*) terms, sum(n)::bigint postings, (select count(*) from d) docs, (select sum(len(ws))::bigint from d) words from p""")
def bm25_stored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored index holds, from its block heads and lengths alone."""
    index = bm25_index.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), _path(spark, "bm25"))
    blocks = index.blocks.groupBy("term").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"))
    docs = index.documents.agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("words"))
    return blocks.join(F.broadcast(docs), how="cross")  # one row each


def _hop_sql(hop: int) -> str:
    """The tables of one hop: its search, new evidence, what is missing, and who goes on."""
    before = f"select query_id, content from ev{hop - 1}" if hop > 1 else "select null query_id, null content where false"
    last = f"left join hops{hop - 1} b using (query_id)" if hop > 1 else "left join (select null::bigint query_id, null::double completeness where false) b using (query_id)"
    return f"""
a{hop} as materialized (select query_id, term, count(*) qtf from (select query_id, unnest({tokens_sql('query')}) term from going{hop}) group by all),
s{hop} as (select query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) score from a{hop} join df using (term) join t using (term), c group by all),
r{hop} as materialized (select query_id, id, content, dl, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s{hop} where score > 0) join d using (id) where rank <= 3),
new{hop} as materialized (select query_id, {hop} hop, content, arg_min(id, rank) id, arg_min(dl, rank) dl from r{hop} where (query_id, content) not in (select (query_id, content) from ({before})) group by query_id, content),
ev{hop} as materialized (select query_id, hop, id, content, dl from new{hop}{f' union all select query_id, hop, id, content, dl from ev{hop - 1}' if hop > 1 else ''}),
met{hop} as (select distinct w.query_id, w.term from words w join ev{hop} e using (query_id) join t on t.id = e.id and t.term = w.term),
told{hop} as (select w.query_id, count(m.term)::double / count(*) completeness, count(*) - count(m.term) n_gaps, array_to_string(list_slice(list(w.term order by w.pos) filter (m.term is null), 1, 4), ' ') next
  from words w left join met{hop} m using (query_id, term) where w.query_id in (select query_id from r{hop}) group by 1),
hops{hop} as materialized (select g.query_id, {hop} hop, g.query, k.completeness, k.n_gaps, coalesce(x.dl, 0)::bigint new_words, k.next,
  case when k.completeness >= 0.8 then 'complete' when k.n_gaps = 0 then 'no_gaps' when {hop} > 1 and coalesce(x.dl, 0) < 50 then 'little_new' when k.completeness <= b.completeness + 0.05 then 'plateau' end reason
  from going{hop} g join told{hop} k using (query_id) left join (select query_id, sum(dl) dl from new{hop} group by 1) x using (query_id) {last}),
going{hop + 1} as materialized (select query_id, next query from hops{hop} where reason is null)"""


HOPS_SQL = f"""with d as materialized (select doc_id id, {tokens_sql('text')} ws, len(ws) dl, sha256(coalesce(text, '')) content from documents),
c as (select count(*) n, avg(dl) avgdl from d), t as materialized (select term, id, dl, count(*) tf from (select id, dl, unnest(ws) term from d) group by all), df as materialized (select term, count(*) df from t group by 1),
asked as (select b.item_id query_id, coalesce(b.text, '') || ' ' || coalesce(x.text, '') q from benchmark b left join benchmark x on x.item_id = b.item_id + 1),
words as materialized (select query_id, term, min(pos) pos from (select query_id, unnest({tokens_sql('q')}) term, generate_subscripts({tokens_sql("q")}, 1) pos from asked) where length(term) > 3 group by 1, 2),
going1 as (select query_id, q query from asked),{','.join(_hop_sql(h) for h in range(1, 6))}
"""


def _hops(spark: SparkSession, sf_dir: str) -> multihop.Hops:
    """Each question is an item and the one after it, so that evidence of both is to be found."""
    index = bm25_index.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), _path(spark, "bm25"))
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("more"))
    asked = b.join(after, "item_id", "left").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("more", F.lit(""))).alias("q"))
    return multihop.retrieve(index, asked)


@query(HOPS_SQL + " ".join(f"{'union all ' * (h > 1)}select query_id, hop, query, round(completeness, 6) completeness, n_gaps, new_words, reason from hops{h}" for h in range(1, 6)))
def multihop_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hop of every question: what was asked, how complete the evidence was after it, and why it was the last."""
    return _hops(spark, sf_dir).hops.select("query_id", "hop", "query", F.round("completeness", 6).alias("completeness"), "n_gaps", "new_words", "reason")


@query(HOPS_SQL + "select query_id, hop, id from ev5")
def multihop_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each question and the hop that found it; copies count once."""
    return _hops(spark, sf_dir).evidence.select("query_id", "hop", "id")
