"""Registered queries: retrieval, ranking, chunking and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions import legal as L
from lexforge.operators import bm25, chunking, filters, ranking, scoring
from lexforge.operators.numbering import number
from lexforge.session import cut, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_.\-]+', ' ', 'g'), ' '), lambda w: w != '')"


def tokens_sql(col: str) -> str:
    """Runs of word characters, dots and hyphens that begin and end in a word character."""
    return rf"list_filter(list_transform({TOKENS.format(col)}, lambda w: regexp_replace(w, '^[.\-]+|[.\-]+$', '', 'g')), lambda w: w != '')"


BM25_SQL = f"""
with d as (select doc_id id, {tokens_sql('text')} ws from documents),
c as (select count(*) n, avg(len(ws)) avgdl from d),
p as (select id, len(ws) dl, unnest(ws) term from d),
t as (select term, id, dl, count(*) tf from p group by all),
df as (select term, count(*) df from t group by 1),
q as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({tokens_sql('text')}) term from benchmark) group by all),
s as (select query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) score
      from q join df using (term) join t using (term), c group by all)
select query_id, id, rank::int as rank, round(score, 6) score from
(select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s where score > 0) where rank <= 10"""


@query(BM25_SQL)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 10)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""
with d as (select doc_id id, {tokens_sql('text')} ws from documents),
t as (select distinct id, unnest(ws) term from d), n as (select count(*) n from d)
select term, count(*) df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) idf from t, n group by 1""")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"select count(*) n, round(avg(len({tokens_sql('text')})), 6) avgdl from documents")
def agg_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(table(spark, sf_dir, "documents"), "doc_id", "text").corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


VECTOR_SQL = """
with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id id, {score} score from q, embeddings where vec_id != query_id)
select query_id, id, rank::int as rank, round(score, 6) score from
(select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s) where rank <= 5"""


def _vector(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return ranking.vector_top_k(queries, rows, 5, metric).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(VECTOR_SQL.format(score="list_cosine_similarity(q, embedding::double[])"))
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, "cosine")


@query(VECTOR_SQL.format(score="list_dot_product(q, embedding::double[])"))
def vec_metrics_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, "dotproduct")


@query(VECTOR_SQL.format(score="-list_distance(q, embedding::double[])"))
def vec_metrics_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, "euclidean")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists a query: by words and by length of shared words."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(spread(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 20).select("query_id", "id", "score")
    short = found.join(docs.select(F.col("doc_id").alias("id"), "n_chars"), "id").select("query_id", "id", (F.lit(1000.0) / (1000.0 + F.col("n_chars"))).alias("score"))
    return found.withColumn("list_id", F.lit("bm25")).unionByName(short.withColumn("list_id", F.lit("short")))


LISTS_SQL = f"""found as (select query_id, id, score from ({BM25_SQL.replace('<= 10', '<= 20').replace('round(score, 6) score', 'score')})),
lists as (select 'bm25' list_id, query_id, id, score from found union all
select 'short', query_id, id, 1000.0::double / (1000.0 + n_chars) from found join documents on id = doc_id)"""


@query(f"""with {LISTS_SQL},
r as (select *, row_number() over (partition by query_id, list_id order by round(score, 9) desc, id) r from lists)
select query_id, id, round(sum(1.0::double / (60 + r)), 6) score, array_to_string(list_sort(list(list_id)), ',') found_by from r group by 1, 2""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.rrf(_lists(spark, sf_dir))
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("found_by", ",").alias("found_by"))


@query(f"""with {LISTS_SQL},
m as (select *, min(score) over (partition by query_id, list_id) lo, max(score) over (partition by query_id, list_id) hi from lists),
s as (select *, case when hi > lo then (score - lo) / (hi - lo) else 1.0 end s from m)
select query_id, id, round(0.4 * coalesce(max(s) filter (list_id = 'bm25'), 0) + 0.6 * coalesce(max(s) filter (list_id = 'short'), 0), 6) score from s group by 1, 2""")
def weighted_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    a, b = lists.where("list_id = 'bm25'"), lists.where("list_id = 'short'")
    return ranking.weighted_fuse(a, b, 0.4, 0.6).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(docs, table(spark, sf_dir, "benchmark"), 20).select("query_id", "id", "score")
    return ranking.mmr(bm25.with_fields(found, docs.select(F.col("doc_id").alias("id"), "text")), 5)


@query(f"""with {LISTS_SQL}, b as (select query_id, id, found.score, d.text, q.text q from found join documents d on doc_id = id join benchmark q on item_id = query_id),
t as (select *, list_distinct(list_filter({tokens_sql('q')}, lambda w: length(w) > 9)) terms from b)
select query_id, id, round(case when len(list_filter(terms, lambda w: contains(lower(text), w))) > 0 then score * 5.0 else score end, 6) score from t""")
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that hold a long word of their question count five times."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = bm25.search(spread(docs.select("doc_id", "text")), items, 20).select("query_id", "id", "score")
    terms = items.select(F.col("item_id").alias("query_id"), F.filter(T.lower_tokens(F.col("text")), lambda w: F.length(w) > 9).alias("terms"))
    joined = bm25.with_fields(cut(found.join(terms, "query_id")), docs.select(F.col("doc_id").alias("id"), "text"))
    return joined.select("query_id", "id", F.round(ranking.boost(F.col("text"), F.col("terms"), F.col("score")), 6).alias("score"))


_SIMPLE = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \\n]'), lambda w: w != ''))"


@query(f"""with {LISTS_SQL}, b as (select query_id, id, round(found.score, 6) score, {_SIMPLE.format('text')} w from found join documents on doc_id = id),
f as (select * from (select *, row_number() over (partition by query_id order by score desc, id) r from b) where r = 1),
s as (select b.query_id, b.id, 0.7 * b.score - 0.3 * case when len(list_distinct(list_concat(b.w, f.w))) = 0 then 0.0 else len(list_intersect(b.w, f.w)) / len(list_distinct(list_concat(b.w, f.w))) end::double m, b.score from b join f using (query_id) where b.id != f.id),
p as (select query_id, id from (select *, row_number() over (partition by query_id order by round(m, 9) desc, score desc, id) r from s) where r = 1)
select query_id, id, 1 pick from f union all select query_id, id, 2 from p""")
def mmr_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two picks of diversity among twenty results of every item."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(spread(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 20).select("query_id", "id", F.round("score", 6).alias("score"))
    return ranking.mmr(bm25.with_fields(found, docs.select(F.col("doc_id").alias("id"), "text")), 2)


@query(f"""with {LISTS_SQL},
p as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) - 1 pos from found),
n as (select *, case when pos % 3 = 0 then null else (id % 97) / 97.0 end fresh from p),
r as (select query_id, id, coalesce(fresh, score) score, row_number() over (partition by query_id order by coalesce(fresh, score) desc, pos) rank from n)
select query_id, id, round(score, 6) score, rank::int as rank from r where rank <= 10""")
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
    placed = found.select("query_id", "id", "score", (F.col("rank") - 1).alias("pos"))
    fresh = placed.where("pos % 3 != 0").select("query_id", "pos", ((F.col("id") % 97) / 97.0).alias("new_score"))
    return ranking.rerank(placed, fresh, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("select doc_id, lang, source from documents where lang = 'en' and source in ('src0', 'src1') and n_chars >= 500")
def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"lang": {"$eq": "en"}, "source": {"$in": ["src0", "src1"]}, "n_chars": {"$gte": 500}, "topic": None}
    return filters.metadata_filter(table(spark, sf_dir, "documents"), spec).select("doc_id", "lang", "source")


_TERMS_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in L.EMPLOYMENT_TERMS) + "]"


@query(f"""with d as (select doc_id, source, lower(concat_ws(' ', source, lang, text)) t from documents)
select doc_id from d where len(list_filter({_TERMS_SQL}, lambda k: contains(t, k))) > 0 or lower(source) in ('chrt', 'cirb', 'fpslreb', 'ohstc', 'sst', 'src3')""")
def filter_keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fields hold any of the employment terms, or that come from a listed tribunal."""
    text = F.concat_ws(" ", "source", "lang", "text")
    listed = F.coalesce(F.lower("source").isin(*L.TRIBUNALS, "src3"), F.lit(False))
    return table(spark, sf_dir, "documents").where(filters.contains_any(text, L.EMPLOYMENT_TERMS) | listed).select("doc_id")


@query("select doc_id, left(text, 1000) content, length(text) n from documents where length(trim(text)) >= 200")
def filter_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 200)
    return docs.select("doc_id", T.truncate(F.col("text"), 1000).alias("content"), F.length("text").alias("n"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def join_anti_ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.not_processed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""select query_id, rank idx, round(score, 3) score, coalesce(nullif(d.source, ''), 'doc_' || d.doc_id) as name, case when length(text) > 500 then left(text, 500) || '...' else text end excerpt from ({BM25_SQL}) r join documents d on d.doc_id = r.id""")
def proj_format_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they are shown: number, score, a name or else the id, an excerpt."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(spread(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 10)
    rows = bm25.with_fields(found, docs.select(F.col("doc_id").alias("id"), "text", "source"))
    name = F.coalesce(F.nullif("source", F.lit("")), F.concat(F.lit("doc_"), "id"))
    return rows.select("query_id", F.col("rank").alias("idx"), F.round(F.round("score", 6), 3).alias("score"), name.alias("name"), T.excerpt(F.col("text")).alias("excerpt"))


@query("""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) body from pages""")
def scan_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("""select link, count(distinct page_id) pages from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) link from pages) group by 1""")
def scan_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("link"))
    return links.groupBy("link").agg(F.count("page_id").alias("pages"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(spread(table(spark, sf_dir, "documents")))


@query()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_overlap(chunking.chunk(spread(table(spark, sf_dir, "documents"))))


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 tokens that share 50; a test runs the rule in plain Python."""
    import public_tokenizers

    return chunking.chunk_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def agg_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each kind of section gives, and their sizes."""
    chunks = chunking.chunk_sections(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n = F.col("token_count")
    return chunks.groupBy("section", "content_type").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(n), 1).alias("avg_tokens"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("""select doc_id, 'doc_summary_' || doc_id id, left(text, 1024) summary from documents""")
def doc_summary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_summary_"), "doc_id").alias("id"), T.truncate(F.col("text"), 1024).alias("summary"))


_CLASS_SQL = "case when kw >= 2 or (kw >= 1 and sem = 0) then 'keyword' when sem >= 2 or (sem >= 1 and kw = 0) then 'semantic' else 'hybrid' end"
_KW_SQL = " + ".join(f"regexp_matches(text, '(?i){p}')::int" for p in scoring.KEYWORD_PATTERNS)
_SEM_SQL = " + ".join(f"contains(lower(text), '{p}')::int" for p in scoring.SEMANTIC_PHRASES)


@query(f"""with c as (select conv_id, turn, {_KW_SQL} kw, {_SEM_SQL} sem from (select *, coalesce(text, '') t from conversations) where role = 'user'),
k as (select conv_id, turn, {_CLASS_SQL} kind from c)
select conv_id, turn, kind, case kind when 'keyword' then 0.7 when 'semantic' then 0.2 else 0.4 end::double w_bm25 from k""")
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", scoring.query_class(F.col("text")).alias("kind"))
    return asked.select("conv_id", "turn", "kind", scoring.query_weights(F.col("kind"))[0].alias("w_bm25"))


@query("""with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\n]'), lambda x: x != '')) ws from documents),
p as (select a.doc_id a, b.doc_id b, a.ws x, b.ws y from w a join w b on b.doc_id = a.doc_id + 1)
select a, b, round(case when len(list_distinct(x || y)) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(x || y)) end, 6) jaccard from p""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.simple_words(F.col("text")).alias("ws"))
    after = w.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("ws").alias("y"))
    return w.select(F.col("doc_id").alias("a"), F.col("ws").alias("x")).join(after, "a").select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("""with l as (select doc_id, text, lang, 'd' kind, n_chars::double score from documents union all
select doc_id, text, lang, 's', n_chars + 0.5 from documents),
r as (select *, row_number() over (partition by md5(coalesce(text, '')) order by score desc, doc_id) r from l)
select doc_id, kind, score from r where r = 1""")
def win_dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.select("doc_id", "text", F.lit("d").alias("kind"), F.col("n_chars").cast("double").alias("score"))
    b = docs.select("doc_id", "text", F.lit("s").alias("kind"), (F.col("n_chars") + F.lit(0.5)).alias("score"))
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    # The best row of each text by a partially combined maximum, so that no group of copies meets in one task.
    best = a.unionByName(b).groupBy(key.alias("k")).agg(F.max_by(F.struct("doc_id", "kind", "score"), F.struct("score", -F.col("doc_id"))).alias("r"))
    return best.select("r.*")
