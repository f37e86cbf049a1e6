"""Registered queries: triples out of documents, and retrieval with what their graph says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import bm25, scoring, treesearch, triples
from lexforge.plans.retrieval import BM25_SQL
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


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '\p{{L}}+')"


_TYPES = "[" + ", ".join(f"'{t}'" for t in triples.ENTITY_TYPES) + "]"
_RELATIONS = "[" + ", ".join(f"'{t}'" for t in triples.RELATION_TYPES) + "]"


def _mentions(name: str, texts: str) -> str:
    """The tables of one search for entities: ``texts`` has id (or query_id and source) and text."""
    return f"""{name}s as (select id, sentence - 1 sentence, {_words('s')} w from (select id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+')) s, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+'), 1) sentence from ({texts}))),
{name}g as (select id, sentence, i as start, i + n stop, array_to_string(w[i + 1:i + n], ' ') gram from (select id, sentence, w, n, unnest(generate_series(0, len(w) - n)) i from {name}s, (select distinct n from ent) where len(w) >= n)),
{name}h as (select id, sentence, start, stop, name, type from {name}g join ent using (gram)),
{name}m as materialized (select * from {name}h x where not exists (select 1 from {name}h y where y.id = x.id and y.sentence = x.sentence and y.start <= x.start and y.stop >= x.stop and y.stop - y.start > x.stop - x.start))"""


ENTITY_SQL = f"""bw as (select item_id, {_words('text')} w from benchmark), en as (select array_to_string(w[1:2], ' ') name, {_TYPES}[1 + item_id % 8] type from bw where len(w) >= 2 union all select array_to_string(w[4:6], ' '), {_TYPES}[1 + (item_id + 3) % 8] from bw where len(w) >= 6
union all select unnest(w), {_TYPES}[1 + (item_id + 5) % 8] from (select item_id, list_filter(w, lambda x: length(x) > 8) w from bw)),
ent as materialized (select name gram, name, min(type) type, len(string_split(name, ' ')) n from en group by name)"""
TRIPLES_SQL = f"""{ENTITY_SQL}, {_mentions('d', 'select doc_id id, text from documents')},
seq as (select id, name subject, type subject_type, stop, lead(name) over w object, lead(type) over w object_type, lead(start) over w after from dm window w as (partition by id, sentence order by start, stop, name, type)),
tri as materialized (select id doc_id, subject, subject_type, {_RELATIONS}[1 + ((list_position({_TYPES}, subject_type) - 1) * 8 + list_position({_TYPES}, object_type) - 1) % 10] predicate, object, object_type, case when after > stop then 1.0 / (1 + after - stop) else 0.8 end confidence from seq where object is not null and object != subject)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to look for: two runs of words of each item and its long words, of the types that their numbers give."""
    kinds = F.array(*map(F.lit, triples.ENTITY_TYPES))
    b = table(spark, sf_dir, "benchmark").select("item_id", triples.words(F.col("text")).alias("w"))
    kind = lambda shift: F.element_at(kinds, ((F.col("item_id") + shift) % 8 + 1).cast("int"))
    two = b.where("size(w) >= 2").select(F.array_join(F.slice("w", 1, 2), " ").alias("name"), kind(0).alias("type"))
    three = b.where("size(w) >= 6").select(F.array_join(F.slice("w", 4, 3), " ").alias("name"), kind(3).alias("type"))
    one = b.select(F.explode(F.filter("w", lambda x: F.length(x) > 8)).alias("name"), kind(5).alias("type"))
    return two.union(three).union(one).groupBy("name").agg(F.min("type").alias("type"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), "text")
    return triples.validated(triples.answers(docs, _entities(spark, sf_dir)))


@query(f"with {TRIPLES_SQL} select doc_id, subject, subject_type, predicate, object, object_type, round(confidence, 6)::double confidence from tri")
def kg_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of every document: names found by the dictionary, said in JSON, read back and validated."""
    return _triples(spark, sf_dir).select(F.col("id").alias("doc_id"), "subject", "subject_type", "predicate", "object", "object_type", F.round("confidence", 6).alias("confidence"))


GRAPH_SQL = f"""{TRIPLES_SQL}, e as materialized (select subject, object, predicate relation, max(confidence) confidence, min(subject_type) subject_type, min(object_type) object_type from tri group by 1, 2, 3),
hop as materialized (select distinct subject s, object o from e union select distinct object, subject from e)"""


def _around(seeds: str) -> str:
    return f"""n0 as (select distinct seed, seed node from ({seeds})), n1 as materialized (select * from n0 union select seed, o from n0 join hop on node = s), n2 as materialized (select * from n1 union select seed, o from n1 join hop on node = s),
ge as materialized (select x.seed, e.* from n2 x join e on e.subject = x.node where (x.seed, e.object) in (select (seed, node) from n2)),
ln as (select distinct seed, 1 part, subject_type line, subject t from ge union select distinct seed, 1, object_type, object from ge union all select seed, 2, relation, subject || ' -> ' || object from ge),
lr as (select *, row_number() over (partition by seed, part, line order by t) r, count(*) over (partition by seed, part, line) n from ln),
lt as (select seed, part, line, line || ' (' || any_value(n) || '): ' || string_agg(t, '; ' order by t) filter (r <= 10) txt from lr group by 1, 2, 3),
ci as (select *, row_number() over (partition by seed order by subject, object) r from ge where relation = 'cites'),
ch as (select seed, 3 part, '' line, 'chain: ' || string_agg(subject, ' -> ' order by r) || ' -> ' || arg_max(object, r) txt from ci where r <= 5 group by 1),
tx as materialized (select seed, string_agg(txt, chr(10) order by part, line) txt from (select * from lt union all select * from ch) group by 1)"""


@query(f"with {GRAPH_SQL}, {_around('select subject seed from e union select object from e')} select seed as entity, txt as text from tx")
def kg_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity of the documents' graph with the entities by type, relations and citation chain two steps around it."""
    edges = cut(triples.edges_of(_triples(spark, sf_dir)))
    seeds = edges.select(F.col("subject").alias("seed")).union(edges.select("object")).distinct()
    return triples.described(triples.around(edges, seeds, 2)).select(F.col("seed").alias("entity"), "text")


@query(f"""with {GRAPH_SQL}, hit as materialized (select query_id, rank, score, text from ({BM25_SQL}) r join documents on doc_id = id where rank <= 5),
hd as (select query_id, string_agg(left(coalesce(text, ''), 200), ' ' order by rank) text from hit where rank <= 3 group by 1),
{_mentions('q', "select {'q': item_id, 'src': 0} id, text from benchmark union all select {'q': query_id, 'src': 1}, text from hd")},
fs as (select id.q query_id, name, min({{'a': id.src, 'b': sentence, 'c': start, 'd': stop}}) pos from qm group by 1, 2),
lk as materialized (select * from (select query_id, name, row_number() over (partition by query_id order by pos, name) place from fs) where place <= 5),
{_around('select name seed from lk')},
cp as (select query_id, 0 part, '=== PASSAGES ===' || chr(10) || string_agg('[Passage ' || rank || ', Score: ' || printf('%.3f', score) || ']' || chr(10) || coalesce(text, ''), chr(10) order by rank) t from hit group by 1),
cg as (select query_id, 1 part, '=== GRAPH ===' || chr(10) || string_agg('About ' || name || chr(10) || txt, chr(10) order by place) t from lk join tx on seed = name group by 1)
select query_id, string_agg(t, chr(10) || chr(10) order by part) context from (select * from cp union all select * from cg) group by 1""")
def vector_graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item five passages and what the documents' graph says, two steps around, of up to five entities
    of the item and its first passages."""
    docs, items, entities = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), _entities(spark, sf_dir)
    found = bm25.search(docs, items, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))
    hits = cut(bm25.with_fields(found, docs.withColumnRenamed("doc_id", "id")).select("query_id", "rank", "score", "text"))
    links = cut(triples.linked(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), hits, entities))
    edges = cut(triples.edges_of(_triples(spark, sf_dir)))
    texts = triples.described(triples.around(edges, links.select(F.col("name").alias("seed")), 2))
    return triples.merged(hits, links, texts)


def sentences(text: F.Column) -> F.Column:
    """What a question asks: its sentences."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def thirds(text: F.Column) -> F.Column:
    """A sub-question in up to three runs of its words; one word stays as it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = F.greatest(F.ceil(F.size(words) / 3).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - 1, step), lambda i: F.array_join(F.slice(words, i + 1, step), " "))
    return F.when(F.size(words) > 1, runs).otherwise(F.array().cast("array<string>"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a search over every item, worth what excerpts of its third to fifth best documents say of a sub-question."""
    docs, items = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")
    found = bm25.search(docs, items, 5).where("rank > 2").select("query_id", "id", "rank")
    texts = bm25.with_fields(found, docs.withColumnRenamed("doc_id", "id")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 500).alias("t")))).alias("e"))
    roots = items.select(F.col("item_id").alias("root"), F.coalesce("text", F.lit("")).alias("question")).join(texts.withColumnRenamed("query_id", "root"), "root", "left")
    roots = roots.select("root", "question", F.coalesce(F.transform("e", lambda x: x["t"]), F.array().cast("array<string>")).alias("evidence"))
    return treesearch.search(roots, sentences, thirds, lambda q: scoring.evidence_heuristic(F.col("evidence"), q), rounds=12)


@query()
def mcts_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of sub-questions of every item after a tree search; a test runs it in plain Python."""
    return treesearch.best_path(_trees(spark, sf_dir)).select("root", "path", "depth", "question", "visits", F.round("mean", 6).alias("mean"))
