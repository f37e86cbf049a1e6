"""Registered queries: filtered and boosted word search, hybrid retrieval, routes, graph retrieval, search trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import legal as L
from lexforge.functions import text as T
from lexforge.operators import ann, answers, bm25, graph, ranking, scoring
from lexforge.plans.analytics import EDGES, _edges
from lexforge.plans.answers import PLAIN_SQL, TALK_SQL, _STOP, _talk
from lexforge.plans.retrieval import _CLASS_SQL, _KW_SQL, _SEM_SQL, BM25_SQL, tokens_sql
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


def _top(rows: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return rows.withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


TOP = "select query_id, id, rank::int as rank, score from (select *, row_number() over (partition by query_id order by score desc, id) rank from (select query_id, id, round(score, 6) score from {0})) where rank <= {1}"


@query(BM25_SQL.replace("from s where score > 0", "from s where score > 0 and id in (select doc_id from documents where lang = 'en')"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents of one language; statistics stay those of the corpus."""
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where("lang = 'en'").select(F.col("doc_id").alias("id"))
    found = bm25.search(docs, table(spark, sf_dir, "benchmark"), 10, allowed=allowed)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"select query_id, rank, coalesce('doc_' || id, 'bm25_' || rank) chunk_id, d.lang, score from ({BM25_SQL}) r join documents d on d.doc_id = r.id")
def bm25_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their fields, and an id of whatever there is."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(docs, table(spark, sf_dir, "benchmark"), 10)
    joined = found.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    return joined.select("query_id", "rank", F.coalesce(F.concat(F.lit("doc_"), "id"), F.concat(F.lit("bm25_"), "rank")).alias("chunk_id"), "lang", F.round("score", 6).alias("score"))


def _es_words(text: Column) -> Column:
    """Words of the index in order: lower-cased, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*L.STOP_WORDS))


#: Every word of a synonym group stands for itself and for all members of all groups it is in.
SAME = {w: sorted({x for g in L.SYNONYMS if w in g for x in g}) for g in L.SYNONYMS for w in g}


def _es_places(text: Column) -> Column:
    same = F.create_map(*[c for w, group in SAME.items() for c in (F.lit(w), F.array(*map(F.lit, group)))])
    return F.transform(_es_words(text), lambda w: F.coalesce(F.try_element_at(same, w), F.array(w)))


ES_WORDS = r"list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "], w))"
_SAME = "case w " + " ".join(f"when '{w}' then {group}" for w, group in SAME.items()) + " else [w] end"
ES_PLACES = "list_transform(" + ES_WORDS + f", lambda w: {_SAME})"


def _field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id, title, body: BM25 of the first line (its title) and of the whole text, with the index's words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), _es_places(F.get(F.split("text", "\n"), F.lit(0))).alias("title"), _es_places(F.col("text")).alias("body"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _es_words(F.col("text")).alias("words"))
    return bm25.field_scores(docs, asked, ["title", "body"])


def _field_sql(field: str, name: str) -> str:
    return f"""d{name} as (select doc_id id, {ES_PLACES.format(field)} ws from documents), c{name} as (select count(*) n, avg(len(ws)) avgdl from d{name}),
t{name} as (select term, id, dl, count(*) tf from (select id, len(ws) dl, unnest(flatten(ws)) term from d{name}) group by all), f{name} as (select term, count(*) df from t{name} group by 1),
s{name} as (select query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) score from q join f{name} using (term) join t{name} using (term), c{name} group by all)"""


FIELDS_SQL = f"""q as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({ES_WORDS.format('text')}) term from benchmark) group by all), {_field_sql("string_split(text, chr(10))[1]", "t")}, {_field_sql("text", "b")},
fields as (select coalesce(st.query_id, sb.query_id) query_id, coalesce(st.id, sb.id) id, coalesce(st.score, 0) title, coalesce(sb.score, 0) body from st full join sb on st.query_id = sb.query_id and st.id = sb.id)"""


@query(f"with {FIELDS_SQL} " + TOP.format("(select query_id, id, greatest(title, body) score from fields)", 10))
def bm25_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word search over two fields with stop words and synonyms; the better field counts."""
    return _top(_field_scores(spark, sf_dir).select("query_id", "id", F.greatest("title", "body").alias("score")), 10)


@query(f"with {FIELDS_SQL} " + TOP.format("(select query_id, id, greatest(3 * title, 2 * body) / 100.0 score from fields)", 10))
def es_boost_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a title worth three and a text worth two, by a hundred."""
    return _top(_field_scores(spark, sf_dir).select("query_id", "id", (F.greatest(3 * F.col("title"), 2 * F.col("body")) / 100.0).alias("score")), 10)


@query(f"""with q as (select item_id query_id, list_distinct({ES_WORDS.format('text')}) ws from benchmark), d as (select doc_id id, {ES_WORDS.format('text')} ws from documents),
m as (select distinct query_id, id, 0.7::double score from q, d where len(q.ws) > 0 and list_has_all(d.ws, q.ws)) select query_id, id, score from (select *, row_number() over (partition by query_id order by id) r from m) where r <= 10""")
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every word of a query, ten at most, of equal score."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _es_words(F.col("text")).alias("words"))
    docs = cut(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), _es_words(F.col("text")).alias("words")))
    return bm25.all_words(docs, asked, 10).withColumn("score", F.lit(0.7))


@query("""with q as (select vec_id query_id, label, embedding::double[] q from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id id, list_cosine_similarity(q, embedding::double[]) score from q join embeddings using (label) where vec_id != query_id)
select query_id, id, rank::int as rank, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s) where rank <= 5""")
def vec_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors within the query's own namespace (label)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label")
    found = ranking.vector_top_k(asked, rows, 5, within="label")
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def vec_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours from an index of every row; a test holds its recall against vec_topk."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return ann.search(ann.build(rows), asked, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_TERMS = " || ".join(f"regexp_extract_all(coalesce(text, ''), '(?i){p}')" for p in L.BOOST_PATTERNS)


@query(f"select doc_id, len(list_distinct(list_filter(list_transform({_TERMS}, lambda t: lower(trim(t))), lambda t: t != '')))::int n_terms from documents")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms to boost a text has."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(L.boost_terms(F.col("text"))).alias("n_terms"))


HYBRID = f"""b as (select query_id, id, score from ({BM25_SQL.replace('<= 10', '<= 50').replace('round(score, 6) score', 'score')})),
qv as (select item_id query_id, embedding::double[] q from benchmark join embeddings on vec_id = item_id),
v0 as (select query_id, vec_id id, list_cosine_similarity(q, embedding::double[]) score from qv, embeddings where vec_id != query_id),
v as (select query_id, id, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) r from v0) where r <= 50),
bn as (select query_id, id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0 end s from b window w as (partition by query_id)),
vn as (select query_id, id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0 end s from v window w as (partition by query_id)),
k0 as (select item_id query_id, {_KW_SQL} kw, {_SEM_SQL} sem from benchmark), k as (select query_id, {_CLASS_SQL} kind from k0),
w as (select query_id, case kind when 'keyword' then 0.7 when 'semantic' then 0.2 else 0.4 end::double wb, case kind when 'keyword' then 0.3 when 'semantic' then 0.8 else 0.6 end::double wv from k),
f as (select coalesce(bn.query_id, vn.query_id) query_id, coalesce(bn.id, vn.id) id, bn.s sb, vn.s sv from bn full join vn on bn.query_id = vn.query_id and bn.id = vn.id),
fused as (select f.query_id, f.id, wb * coalesce(sb, 0) + wv * coalesce(sv, 0) score from f join w using (query_id))"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id, score: fifty by words and fifty by vectors, each retrieved on its own, fused by the weights of the
    question's class and boosted by its terms. A question's vector is that of its number among the embeddings."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    words = bm25.search(docs, items, 50).select("query_id", "id", "score")
    numbers = cut(items.select(F.col("item_id").alias("id")))
    asked = bm25.with_fields(numbers, rows).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = ranking.vector_top_k(asked, rows, 50).select("query_id", "id", "score")
    x = words.select("query_id", "id", ranking.min_max(words, ["query_id"]).alias("sb"))
    y = near.select("query_id", "id", ranking.min_max(near, ["query_id"]).alias("sv"))
    kind = scoring.query_class(F.col("text"))
    weights = items.select(F.col("item_id").alias("query_id"), *[w.alias(n) for n, w in zip(("wb", "wv"), scoring.query_weights(kind))], L.boost_terms(F.col("text")).alias("terms"))
    both = x.join(y, ["query_id", "id"], "full_outer").join(weights, "query_id")
    fused = cut(both.select("query_id", "id", "terms", (F.col("wb") * F.coalesce("sb", F.lit(0.0)) + F.col("wv") * F.coalesce("sv", F.lit(0.0))).alias("score")))
    held = bm25.with_fields(fused, docs.select(F.col("doc_id").alias("id"), "text", "lang", "source"), how="left")
    return held.select("query_id", "id", "text", L.boosted(F.coalesce("text", F.lit("")), [F.col("lang"), F.col("source")], F.col("terms"), F.col("score")).alias("score"))


@query(f"with {HYBRID} " + TOP.format("fused", 10))
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of hybrid retrieval, before diversity."""
    return _top(_hybrid(spark, sf_dir), 10)


@query()
def hybrid_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval to its end: fifty fused candidates a question, ten of them chosen for score and diversity."""
    best = cut(_top(_hybrid(spark, sf_dir), 50))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ranking.mmr(bm25.with_fields(best, texts, how="left").select("query_id", "id", "score", "text"), 10)


@query(f"""with t as (select query_id, avg(score) m from ({BM25_SQL}) group by 1) select query_id, round(m, 6) avg_score, case when m > 0.8 then 'high' when m > 0.6 then 'medium' else 'low' end as label from t""")
def conf_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    m = found.groupBy("query_id").agg(F.avg(F.round("score", 6)).alias("m"))
    return m.select("query_id", F.round("m", 6).alias("avg_score"), ranking.confidence_label(F.col("m")).alias("label"))


@query(f"""with {TALK_SQL}, w as (select conv_id, answer, list_filter({PLAIN_SQL.format('answer')}, lambda w: not list_contains({_STOP}, w)) o, {PLAIN_SQL.format('sources')} t from talk),
s as (select conv_id, answer, case when len(t) = 0 then 0.0 when len(o) = 0 then 1.0 else len(list_intersect(o, t)) / len(o) end::double support from w)
select conv_id, case when support < 0.3 then 'Low confidence: the sources may not answer this.' when support < 0.5 then coalesce(answer, '') || ' (Confidence notice: parts may not be supported.)' else answer end reply from s""")
def conf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they are sent: refused, hedged, or whole."""
    rated = answers.confidence(_talk(spark, sf_dir))
    hedged = F.concat(F.coalesce("answer", F.lit("")), F.lit(" (Confidence notice: parts may not be supported.)"))
    return rated.select("conv_id", F.when(F.col("action") == "refuse", "Low confidence: the sources may not answer this.").when(F.col("action") == "hedge", hedged).otherwise(F.col("answer")).alias("reply"))


_CPX = " + ".join(f"contains(lower(t), '{p}')::int" for p in scoring.COMPLEX_PHRASES)


@query(f"""with c as (select conv_id, turn, coalesce(text, '') t from conversations where role = 'user'), r as (select conv_id, turn, case when conv_id % 7 = 0 then 'graph' when ({_CPX}) >= 2 or len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w != '')) > 40 or length(t) - length(replace(t, '?', '')) > 1 then 'tree' else 'single' end route from c)
select route, count(*) n from r group by 1""")
def smart_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions each way of answering gets; graph mode is asked for in one of seven conversations."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    route = F.when(F.col("conv_id") % 7 == 0, "graph").when(scoring.is_complex(F.coalesce("text", F.lit(""))), "tree").otherwise("single")
    return c.select(route.alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select l_suppkey s, l_partkey o, l_orderkey * 10 + l_linenumber ord, case when l_returnflag = 'R' then 'RETURNED' else 'SOLD' end relation, l_discount confidence from lineitem)
select 's' || s as subject, 'p' || o as object, arg_max(relation, ord) relation, arg_max(confidence, ord) confidence from t group by s, o""")
def kg_add_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples upserted: one edge a pair, the last one gives relation and confidence."""
    li = table(spark, sf_dir, "lineitem")
    t = li.select(F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.concat(F.lit("p"), "l_partkey").alias("object"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_returnflag") == "R", "RETURNED").otherwise("SOLD").alias("relation"), F.col("l_discount").alias("confidence"))
    return graph.upsert_edges(t)


@query(f"""with {EDGES}, n as (select distinct s id from b) select left(id, 1) as type, count(*) n from n group by 1""")
def agg_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    t = e.select("subject", "object", F.substring("subject", 1, 1).alias("subject_type"), F.substring("object", 1, 1).alias("object_type"), F.lit(1).alias("ord"))
    return graph.nodes_of(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {EDGES}, f1 as (select distinct o id from b where s = 'n3' union select 'n3'), f2 as (select distinct o id from b where s in (select id from f1) union select id from f1)
select s as subject, o as object, relation from e where s in (select id from f2) and o in (select id from f2)""")
def kg_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges among the nodes within two steps of one."""
    e = cut(_edges(spark, sf_dir))
    near = cut(graph.bfs(e, spark.createDataFrame([("n3",)], "id string"), 2))
    return graph.induced(e, near).select("subject", "object", "relation")


PARTS = f"""wd as (select 'p' || p_partkey id, {tokens_sql("p_name || ' ' || p_type")} ws from part), dg as (select 'p' || l_partkey id, count(distinct l_suppkey)::double d from lineitem group by 1)"""


@query(f"""with {PARTS}, a as (select (select ws[1:2] from wd where id = 'p1') q) select id, round(d * (0.1 + len(list_intersect(q, ws)) / len(q)), 6) score from dg join wd using (id), a""")
def kg_node_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their rank (here their degree) and the share of the question's words they hold."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), T.lower_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    degree = _edges(spark, sf_dir).where("relation = 'SUPPLIES'").groupBy(F.col("object").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    question = part.where("id = 'p1'").agg(F.slice(F.first("words"), 1, 2).alias("q"))
    scored = degree.join(part, "id").join(F.broadcast(question), how="cross")  # one row
    return graph.node_scores(scored.select("id", "score"), scored.select("id", "words", "q"), F.col("q")).select("id", F.round("score", 6).alias("score"))


@query(f"""with {EDGES}, {PARTS}, seeds as (select 's' || s_suppkey id from supplier where s_nationkey = 3), near as (select distinct o id from b where s in (select id from seeds)),
a as (select (select ws[1:2] from wd where id = 'p1') q), sc as (select id, d * (0.1 + len(list_intersect(q, ws)) / len(q)) score from dg join wd using (id), a where id in (select id from near))
select 'graph' section, id, rank::int as rank from (select id, row_number() over (order by round(score, 9) desc, id) rank from sc) where rank <= 5
union all select 'passage', 'd' || id, rank from ({BM25_SQL}) where query_id = 1 and rank <= 5""")
def graphrag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph and passages together: the five best nodes around some entities, and the five best documents."""
    e = _edges(spark, sf_dir)
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    near = graph.bfs(e, seeds, 1).where("depth = 1").select("id")
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), T.lower_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    degree = e.where("relation = 'SUPPLIES'").groupBy(F.col("object").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score")).join(near, "id", "left_semi")
    question = part.where("id = 'p1'").agg(F.slice(F.first("words"), 1, 2).alias("q"))
    words = part.join(F.broadcast(question), how="cross")  # one row
    best = graph.node_scores(degree, words, F.col("q")).orderBy(F.desc(F.round("score", 9)), "id").limit(5)
    nodes = best.select(F.lit("graph").alias("section"), "id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"))  # five rows
    found = bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").where("item_id = 1"), 5)
    return nodes.unionByName(found.select(F.lit("passage").alias("section"), F.concat(F.lit("d"), "id").alias("id"), "rank"))


TREE = """tree as (select 'r' || r_regionkey id, null parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
leaf as (select 'c' || c_custkey id, greatest(c_acctbal, 0) / 10000.0 reward from customer),
up as (select 'c' || c_custkey c, 'c' || c_custkey id from customer union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'c' || c_custkey, 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey),
done as (select up.id, count(*) visits, sum(reward) total from up join leaf on up.c = leaf.id group by 1)"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions over nations over customers, and the reward of each customer."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree = r.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")).union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(c.select(key("c", "c_custkey"), key("n", "c_nationkey")))
    return tree, c.select(key("c", "c_custkey").alias("id"), (F.greatest("c_acctbal", F.lit(0.0)) / 10000.0).alias("reward"))


@query(f"with {TREE} select id, visits, round(total, 6) total from done")
def mcts_backprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, rewards = _tree(spark, sf_dir)
    return graph.backpropagate(tree, rewards).select("id", "visits", F.round("total", 6).alias("total"))


@query(f"""with {TREE}, n1 as (select parent root, arg_max(done.id, total / visits) id from done join tree using (id) where starts_with(done.id, 'n') group by 1),
n2 as (select root, arg_max(done.id, total / visits) id from n1 join tree on tree.parent = n1.id join done on done.id = tree.id group by 1)
select id as root, 0 step, id from tree where parent is null union all select root, 1, id from n1 union all select root, 2, id from n2""")
def mcts_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every region the nation of best mean, and its best customer."""
    tree, rewards = _tree(spark, sf_dir)
    held = tree.join(graph.backpropagate(tree, rewards), "id")
    return graph.best_path(held)


@query(f"""with {TREE} select left(id, 1) as level, round(avg(total / visits), 6) confidence from done group by 1""")
def agg_path_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of visited nodes a level."""
    tree, rewards = _tree(spark, sf_dir)
    done = graph.backpropagate(tree, rewards)
    return done.groupBy(F.substring("id", 1, 1).alias("level")).agg(F.round(F.avg(F.col("total") / F.col("visits")), 6).alias("confidence"))


@query("""with a as (select event_id, least(1.0, greatest(0.0, value / 60.0)) s, event_id % 5 k from events) select event_id, round(case when k in (3, 4) then 0.5 else s end, 6)::double score, k != 4 parsed from a""")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of judges' answers: plain, fenced and cut JSON is read, what has no number counts a half."""
    body = F.concat(F.lit('{"score": '), (F.col("value") / 60.0).cast("string"))
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.concat(body, F.lit("}"))).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("}\n``` done"))).when(k == 2, F.concat(body, F.lit(', "why": "bec'))).when(k == 3, F.lit('{"other": 1}')).otherwise(F.lit("no idea"))
    e = table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return e.select("event_id", F.round(L.judge_score(F.col("said"), "score"), 6).alias("score"), L.json_object(F.col("said")).isNotNull().alias("parsed"))


@query("""with w as (select doc_id, list_slice(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), 1, 30) ws from documents),
b as (select doc_id, ws, 'Sure: ["' || array_to_string(ws, '", "') || '"] done' body from w), c as (select doc_id, ws, 6 + (doc_id * 7) % (length(body) - 5) keep, length(body) n from b),
p as (select doc_id, keep, 7 + sum(length(t) + 4) over (partition by doc_id order by i) - 2 till from (select doc_id, keep, unnest(ws) t, generate_subscripts(ws, 1) i from c)),
f as (select doc_id, count(*) filter (till <= keep) n from p group by 1)
select doc_id, case when keep >= 7 then coalesce(f.n, 0) + case when len(ws) = 0 and keep >= 9 then 1 else 0 end end::int n from c left join f using (doc_id)""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members survive of an array within an answer that is cut off anywhere; null before it begins."""
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), 1, 30)
    body = F.concat(F.lit('Sure: ["'), F.array_join(words, '", "'), F.lit('"] done'))
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    cut_off = docs.select("doc_id", F.left("body", (6 + (F.col("doc_id") * 7) % (F.length("body") - 5)).cast("int")).alias("said"))
    return cut_off.select("doc_id", F.json_array_length(L.json_array(F.col("said"))).alias("n"))
