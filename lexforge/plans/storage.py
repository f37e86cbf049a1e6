"""Registered queries: sources and sinks. Each writes what it derives from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge.functions import legal as L
from lexforge.functions import text as T
from lexforge.operators import filters
from lexforge.operators.numbering import number
from lexforge.session import shared_dir, table

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


PAGE_TEXT = ["page_id bigint, url string, title string", ("page_id", "url")]


@query("select page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title from pages")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as CSV with a header, read back with a schema and a check of its columns."""
    path = _path(spark, "csv")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", T.html_title(F.col("html")).alias("title"))
    pages.write.option("header", True).option("escape", '"').csv(path)
    return S.read_csv(spark, path, PAGE_TEXT[0], PAGE_TEXT[1]).select("page_id", "url", F.coalesce("title", F.lit("")).alias("title"))


@query("""select doc_id, 'Document ' || doc_id || ' (' || coalesce(lang, '') || ') of ' || coalesce(source, '') || ': ' || n_chars || ' characters' content
from documents where doc_id in (select doc_id from labels)""")
def scan_csv_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "csv_documents")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").write.option("header", True).csv(path)
    rows = S.read_csv(spark, path, "doc_id bigint, lang string, source string, n_chars bigint", ("doc_id", "lang"))
    docs = S.read_documents(rows, "Document %s (%s) of %s: %s characters", ["doc_id", "lang", "source", "n_chars"], table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "content")


@query("select n_nationkey, n_name, n_regionkey from nation")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, kind = _path(spark, "nations"), "n_nationkey int, n_name string, n_regionkey int"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return S.read_csv(spark, path, kind, ("n_name",))


@query("select s_nationkey nation, s_suppkey id, s_name as name from supplier")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one JSON document a nation, read whole and exploded."""
    path = _path(spark, "json")
    table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("cases")).repartition(8, "nation").write.partitionBy("nation").json(path)
    return S.records(spark, path, "nation int, cases array<struct<id:bigint,name:string>>", "cases").select("nation", "id", "name")


@query("select conv_id, turn, role, text from conversations")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON lines with blank lines between, appended and read back."""
    path, c = _path(spark, "jsonl"), table(spark, sf_dir, "conversations")
    lines = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    c.select(F.explode(F.array(lines, F.lit(" "))).alias("value")).write.mode("append").text(path)
    return S.read_json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("""with c as (select doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // 3800)) i from documents where text is not null),
k as (select doc_id, i::int chunk_index, substring(text, i * 3800 + 1, 4000) content from c)
select doc_id || '_chunk' || (chunk_index + 1) as id, doc_id, chunk_index, length(content)::int n, md5(content) h from k""")
def scan_jsonl_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 4000 characters, each with 200 of the one before, saved as JSON lines and reloaded."""
    path = _path(spark, "chunks")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 3800).cast("int")), lambda i: F.substring(F.col("text"), i * 3800 + 1, F.lit(4000)))
    chunks = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(parts).alias("chunk_index", "content"))
    chunks.withColumn("id", F.concat("doc_id", F.lit("_chunk"), F.col("chunk_index") + 1)).write.json(path)
    back = S.read_json_lines(spark, path, "id string, doc_id bigint, chunk_index int, content string")
    return back.select("id", "doc_id", "chunk_index", F.length("content").alias("n"), F.md5(F.col("content").cast("binary")).alias("h"))


@query("select distinct source dataset from documents where source is not null order by 1")
def scan_dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _path(spark, "datasets")
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "n_chars", "source")
    docs.repartition(8, "source").write.partitionBy("source").parquet(root)
    return S.datasets(spark, root).select(F.regexp_replace("dataset", "^source=", "").alias("dataset"))


@query("select page_id, upper(regexp_extract(url, '^https?://[^/]+/([A-Za-z]+)(/|$)', 1)) jurisdiction, upper(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)) lang from pages")
def scan_html_canlii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdiction from the first segment of the address, and the language a page states."""
    return table(spark, sf_dir, "pages").select("page_id", F.upper(F.regexp_extract("url", "^https?://[^/]+/([A-Za-z]+)(/|$)", 1)).alias("jurisdiction"), F.upper(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("lang"))


@query("select page_id, contains(lower(html), 'captcha') or contains(lower(html), 'verify you are human') captcha, length(html) >= 200 long_enough from pages")
def scan_html_captcha(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", (F.contains(low, F.lit("captcha")) | F.contains(low, F.lit("verify you are human"))).alias("captcha"), (F.length("html") >= 200).alias("long_enough"))


@query("""with l as (select distinct unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) link from pages), p as (select link from l where starts_with(link, '/t') order by link limit 100)
select link, regexp_extract(link, '([^/]*)$', 1) id from p""")
def scan_links_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred distinct links under a path prefix, and their last segment."""
    links = table(spark, sf_dir, "pages").select(F.explode(T.html_links(F.col("html"))).alias("link")).where("startswith(link, '/t')").distinct()
    return links.orderBy("link").limit(100).select("link", F.regexp_extract("link", "([^/]*)$", 1).alias("id"))


@query("select vec_id, ((row_number() over (order by vec_id) - 1) // 100)::bigint page from embeddings")
def scan_ids_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with its page of a hundred."""
    return number(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], "at").select("vec_id", F.floor(F.col("at") / 100).alias("page"))


@query("select vec_id, label, len(embedding)::int dims from embeddings order by vec_id limit 10000")
def scan_vector_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the store, the first ten thousand by id."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims")).orderBy("vec_id").limit(10_000)


@query("""with t as (select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title, url from pages)
select page_id, title, url, case when page_id % 3 = 0 then 0.5 else (page_id % 10) / 10.0 end::double score from t union all select page_id, 'box ' || page_id, '', 0.7 from t where page_id % 5 = 0""")
def scan_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as answers of a metasearch service: some results without a score, some with an infobox."""
    score = F.when(F.col("page_id") % 3 != 0, (F.col("page_id") % 10) / 10.0)
    result = F.struct(T.html_title(F.col("html")).alias("title"), "url", T.strip_html(F.col("html")).alias("content"), score.alias("score"))
    box = F.when(F.col("page_id") % 5 == 0, F.array(F.struct(F.concat(F.lit("box "), "page_id").alias("infobox"), F.lit("x").alias("content"))))
    answers = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(F.array(result).alias("results"), box.alias("infoboxes"))).alias("body"))
    rows = answers.select("page_id", F.explode(S.search_response(F.col("body"))).alias("r"))
    return rows.select("page_id", "r.title", "r.url", "r.score")


@query("""with base as (select vec_id, label namespace, 0 version, embedding[1] x from embeddings), new as (select vec_id, label, 1, -embedding[1] from embeddings where vec_id % 3 = 0),
u as (select * from base union all select * from new) select vec_id, namespace, arg_max(version, version) as version, round(arg_max(x, version), 6)::double x from u group by 1, 2""")
def sink_upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors upserted by id and namespace into a table of buckets, the last version wins."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("namespace"), F.lit(0).alias("version"), F.col("embedding").alias("v"))
    changed = e.where("vec_id % 3 = 0").withColumn("version", F.lit(1)).withColumn("v", F.transform("v", lambda x: -x))
    stored = S.BucketTable.create(e.limit(0), _path(spark, "vectors"), ["vec_id", "namespace"], 16)
    stored.upsert(e, "version")
    stored.upsert(changed, "version")
    return stored.read(e.schema).select("vec_id", "namespace", "version", F.round(F.get("v", F.lit(0)), 6).cast("double").alias("x"))


@query("""select vec_id, left(text, 10000) content, label || ',1,2' tags, len(embedding)::int dims from embeddings join documents on doc_id = vec_id where len(embedding) > 0""")
def sink_upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector, content held to 10,000 characters in the store (its field's limit), lists to ten."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) > 0")
    joined = e.join(table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id"))
    rows = joined.select("vec_id", F.substring("text", 1, 10_000).alias("content"), F.array_join(F.slice(F.array(F.col("label").cast("string"), F.lit("1"), F.lit("2")), 1, 10), ",").alias("tags"), F.size("embedding").alias("dims"))
    return S.replace(spark, rows, _path(spark, "documents_with_vectors"))


@query("select 'first' store, count(*) n, sum(event_id)::bigint s from events union all select 'second', count(*), sum(event_id)::bigint from events")
def sink_dual_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches into two sinks, the second of them twice, as after a failure: each sink holds it once."""
    first, second = S.Sink.open(spark, _path(spark, "first")), S.Sink.open(spark, _path(spark, "second"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    for batch in (0, 1, 1, 2):
        S.dual_write(events.where(F.coalesce(F.col("event_id") % 3, F.lit(0)) == batch), batch, first, second)
    both = [s.read(events.schema).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s")).withColumn("store", F.lit(n)) for n, s in (("first", first), ("second", second))]
    return both[0].unionByName(both[1])


@query("select doc_id, lang, source, ((row_number() over (order by doc_id) - 1) // 500)::bigint batch from documents")
def sink_bulk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the fields an index takes, in batches of 500, stored by batch."""
    rows = number(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["doc_id"], "at")
    return S.replace(spark, rows.select("doc_id", "lang", "source", F.floor(F.col("at") / 500).alias("batch")), _path(spark, "bulk"), ["batch"])


@query("select source, count(*) n, round(avg(n_chars), 4) mean from documents group by 1")
def sink_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "report")
    S.write_report(table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")), path)
    return S.read_json_lines(spark, path, "source string, n bigint, mean double")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null) and coalesce(lang, '') != 'fr'")
def sink_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some ids and a whole namespace (language) dropped from a table of buckets."""
    docs, bad = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1")
    stored = S.BucketTable.create(docs, _path(spark, "kept"), ["doc_id"], 16)
    stored.delete(bad.select("doc_id").union(docs.where("lang = 'fr'").select("doc_id")), docs.schema)
    return stored.read(docs.schema)


@query("select doc_id as id, left(text, 5000) content, left(source, 3) source from documents")
def sink_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store copied to another whose fields are shorter."""
    docs = table(spark, sf_dir, "documents")
    return S.replace(spark, docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 5000).alias("content"), F.substring("source", 1, 3).alias("source")), _path(spark, "migrated"))


@query("select doc_id, case when doc_id % 2 = 0 then source else 'imported' end source from documents")
def sink_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    have, come = docs.where("doc_id % 2 = 0"), docs.withColumn("source", F.lit("imported"))
    return S.replace(spark, S.insert_if_absent(have, come, "doc_id"), _path(spark, "inserted"))


@query("""select id, regexp_replace(id, '_chunk[0-9]+$', '') parent_id from (select source || '_' || doc_id || '_chunk' || (n_chars % 7) as id, doc_id from documents where starts_with(source, 'src1'))
where doc_id not in (select doc_id from labels where doc_id is not null)""")
def sink_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an id prefix that no checkpoint lists get their parent id and boost terms."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").startswith("src1"))
    rows = filters.not_processed(docs, table(spark, sf_dir, "labels"), "doc_id").withColumn("id", F.concat("source", F.lit("_"), "doc_id", F.lit("_chunk"), F.col("n_chars") % 7))
    made = rows.select("id", F.regexp_replace("id", "_chunk[0-9]+$", "").alias("parent_id"), L.boost_terms(F.col("text")).alias("boost_terms"))
    return S.replace(spark, made, _path(spark, "enriched")).select("id", "parent_id")


@query("select conv_id parent_id, left(arg_min(text, turn), 4096) content from conversations group by 1")
def sink_parent_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first piece of each parent, held to the 4096 characters of its field."""
    first = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("parent_id")).agg(F.min_by("text", "turn").alias("content"))
    return S.replace(spark, first.withColumn("content", F.substring("content", 1, 4096)), _path(spark, "parents"))


@query("select ts::date::varchar as day, count(*) n, count(distinct user_id) users from events group by 1")
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as JSON lines, a folder a day, and summed from there."""
    from lexforge.streaming.events import append_log

    path = _path(spark, "log")
    append_log(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), path)
    back = spark.read.schema("event_id bigint, user_id bigint, ts timestamp_ntz, day date").json(path)
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""with r as (select conv_id, turn, text, first_value(text) over (partition by conv_id order by turn) parent from conversations)
select conv_id, turn, coalesce(case when turn % 2 = 1 then parent end, text) content from r""")
def join_parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd turns expand to their parent's content; where no parent is stored the turn's own stays."""
    c = table(spark, sf_dir, "conversations")
    parents = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("parent")).withColumn("odd", F.lit(1))
    joined = c.withColumn("odd", F.col("turn") % 2).join(parents, ["conv_id", "odd"], "left")
    return joined.select("conv_id", "turn", F.coalesce("parent", "text").alias("content"))


@query("""select doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int as rank from documents where n_chars >= 300 qualify rank <= 5""")
def filter_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each source among those of a least score."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").where("n_chars >= 300").select("doc_id", rank.alias("rank")).where("rank <= 5")
