"""Registered queries: projections, joins, evaluation rollups, limits and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import legal as L
from lexforge.functions import text as T
from lexforge.operators import filters, graph, scoring
from lexforge.plans.analytics import _feedback
from lexforge.session import table
from lexforge.streaming import events as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


n_rows = lambda: F.count(F.lit(1))
mean = lambda c: F.avg(c.cast("double"))


@query("""select c_custkey, count(o_orderkey) orders, round(coalesce(sum(o_totalprice), 0), 2) spent from customer left join orders on c_custkey = o_custkey group by 1""")
def join_left_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows().alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("""with c as (select o_orderkey k, o_orderpriority p, 0 v from orders union all select o_orderkey, 'CHANGED', 1 from orders where o_orderstatus = 'F')
select k, arg_max(p, v) p from c group by 1""")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.lit(0).alias("v"))
    new = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("CHANGED").alias("p"), F.lit(1).alias("v"))
    return filters.upsert(base, new, "k", "v").select("k", "p")


@query("select o_orderkey, year(o_orderdate)::varchar as year from orders where year(o_orderdate)::varchar >= '1994' and year(o_orderdate)::varchar <= '1996' order by 2, 1")
def filter_gte_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a range of years, both ends given, sorted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"))
    return filters.metadata_filter(o, {"year": {"$gte": "1994", "$lte": "1996"}}).orderBy("year", "o_orderkey")


@query("select doc_id from documents where lang = 'de' and source in ('src0', 'src1', 'src2')")
def filter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit fields, those unset left out, overridden by a generic filter."""
    spec = filters.merge_filters({"lang": "en", "source": None}, {"lang": "de", "source": ["src0", "src1", "src2"]})
    return filters.metadata_filter(table(spark, sf_dir, "documents"), spec).select("doc_id")


@query("select event_id, event_type in ('click', 'view', 'purchase') valid from events")
def filter_enum_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("event_type").isin("click", "view", "purchase"), F.lit(False)).alias("valid"))


@query("""select page_id, case when page_id % 2 = 0 and url != '' then url else 'https://search.example.org/?q=' || replace(url_encode('"' || trim(title) || '"'), '+', '%20') end source_url
from (select page_id, url, 'Case ' || page_id || ' v Crown' title from pages)""")
def proj_source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of a source, or a search for its quoted name."""
    title = F.concat(F.lit('"Case '), "page_id", F.lit(' v Crown"'))
    own = F.when(F.col("page_id") % 2 == 0, F.nullif("url", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(own, F.concat(F.lit("https://search.example.org/?q="), L.encoded(title))).alias("source_url"))


def _names_sql(names: dict[str, str], col: str, other: str) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {other} end"


_CODES = [*L.COURTS, "ABCA"]


@query(f"""with c as (select *, ['{"', '".join(_CODES)}'][doc_id % {len(_CODES)} + 1] code from documents)
select 'a2aj_' || left(md5(code || '_' || doc_id), 12) id, {_names_sql(L.COURTS, 'code', 'code')} court, {_names_sql(L.JURISDICTIONS, 'code', "'Canada'")} jurisdiction, left(text, 200) title from c where length(trim(text)) >= 200""")
def proj_doc_from_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dataset as documents: court and jurisdiction by code, id by hash, title held to 200 characters."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % len(_CODES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 200).withColumn("code", code)
    id_ = F.concat(F.lit("a2aj_"), F.substring(F.md5(F.concat_ws("_", "code", "doc_id").cast("binary")), 1, 12))
    return docs.select(id_.alias("id"), L.looked_up(F.col("code"), L.COURTS, F.col("code")).alias("court"), L.looked_up(F.col("code"), L.JURISDICTIONS, F.lit("Canada")).alias("jurisdiction"), F.substring("text", 1, 200).alias("title"))


def _first_sql(rules: list, other: str) -> str:
    test = lambda phrases: " or ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in phrases)
    return "case " + " ".join(f"when {test(p)} then '{n}'" for n, p in rules) + f" else '{other}' end"


@query(f"select doc_id, {_first_sql(L.TOPICS, L.OTHER_TOPIC)} topic from documents")
def proj_topic_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.first_of(F.col("text"), L.TOPICS, L.OTHER_TOPIC).alias("topic"))


@query(f"select conv_id, turn, {_first_sql(L.INTENTS, L.OTHER_INTENT)} as template from conversations where role = 'user'")
def template_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", L.first_of(F.col("text"), L.INTENTS, L.OTHER_INTENT).alias("template"))


@query("select p_partkey, p_brand as brand_feature, p_type as type_feature, coalesce(p_size, 0) size_feature from part")
def proj_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand_feature"), F.col("p_type").alias("type_feature"), F.coalesce("p_size", F.lit(0)).alias("size_feature"))


@query("select doc_id, coalesce(source, 'unknown') source, left(coalesce(text, ''), 200) preview from documents")
def proj_docs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("preview"))


@query("""with best as (select doc_id id, n_chars / 1000.0 score, 'chunk' kind from documents where n_chars % 2 = 0), s as (select doc_id id, 0.4::double score, 'summary' kind from documents)
select * from (select id, score::double score, kind from best union all select * from s where id not in (select id from best)) order by score desc, id limit 200""")
def join_doc_level_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of chunks, and those of summaries whose document has none, sorted."""
    docs = table(spark, sf_dir, "documents")
    best = docs.where("n_chars % 2 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"), F.lit("chunk").alias("kind"))
    more = docs.select(F.col("doc_id").alias("id"), F.lit(0.4).alias("score"), F.lit("summary").alias("kind"))
    return best.unionByName(more.join(best.select("id"), "id", "left_anti").select("id", "score", "kind")).orderBy(F.desc("score"), "id").limit(200)


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def join_semi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("""with q as (select s_suppkey query_id, case when s_suppkey % 2 = 0 then upper(n_name) else substring(n_name, 2, 4) end q from supplier join nation on s_nationkey = n_nationkey),
h as (select query_id, n_nationkey id, lower(n_name) != lower(q) other from q join nation on lower(n_name) = lower(q) or contains(lower(n_name), lower(q)) or contains(lower(q), lower(n_name)) where q != ''),
r as (select *, row_number() over (partition by query_id order by other, id) r from h) select query_id, id from r where r = 1""")
def join_theta_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of nations, whole or in part, looked up among the nations (a fixed number of names)."""
    nation = table(spark, sf_dir, "nation")
    asked = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    q = F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.substring("n_name", 2, 4))
    names = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return graph.find_entity(asked.select(F.col("s_suppkey").alias("query_id"), q.alias("q")), names)


@query("""with z as (select vec_id, unnest(embedding) w, generate_subscripts(embedding, 1) - 1 as i from embeddings), r as (select *, row_number() over (partition by vec_id order by w desc, i) r from z)
select vec_id, i::int feature, round(w::double, 6) weight from r where r <= 5""")
def sort_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five components of greatest weight of each vector, zipped with their positions."""
    zipped = F.transform("embedding", lambda w, i: F.struct((-w).alias("w"), i.alias("i")))
    top = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.slice(F.array_sort(zipped), 1, 5)).alias("z"))
    return top.select("vec_id", F.col("z.i").alias("feature"), F.round(-F.col("z.w").cast("double"), 6).alias("weight"))


@query("""with z as (select vec_id, list_zip(embedding, list_transform(embedding, lambda x: x * x)) z from embeddings) select vec_id, round(list_sum(list_transform(z, lambda p: p[1] * p[2]))::double, 5) cubes from z""")
def join_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays joined by position."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    zipped = F.arrays_zip(F.col("embedding").alias("a"), squares.alias("b"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(zipped, F.lit(0.0), lambda s, p: s + p["a"].cast("double") * p["b"]), 5).alias("cubes"))


CASES = """cases as (select d.doc_id, source difficulty, quality expected, toxic, (length(text) > 300)::int predicted, least(n_chars / 1000.0, 1.0)::double score from documents d join labels l on d.doc_id = l.doc_id)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case results joined with what their suite expects."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    joined = d.join(l, "doc_id")
    return joined.select("doc_id", F.col("source").alias("difficulty"), F.col("quality").alias("expected"), "toxic", (F.length("text") > 300).cast("int").alias("predicted"), F.least(F.col("n_chars") / 1000.0, F.lit(1.0)).alias("score"))


@query(f"with {CASES} select doc_id, expected, predicted, expected = predicted correct from cases")
def join_seed_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("doc_id", "expected", "predicted", (F.col("expected") == F.col("predicted")).alias("correct"))


@query(f"""with {CASES} select difficulty, count(*) n, round(avg((expected = predicted)::int), 4) accuracy, round(avg(score), 4) mean_score, round(avg(toxic), 4) mean_toxic from cases group by rollup (difficulty)""")
def agg_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and means by difficulty and overall (null difficulty)."""
    right = (F.col("expected") == F.col("predicted")).cast("int")
    return _cases(spark, sf_dir).rollup("difficulty").agg(n_rows().alias("n"), F.round(mean(right), 4).alias("accuracy"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(mean(F.col("toxic")), 4).alias("mean_toxic"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def join_fk_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose owner passes a test."""
    owner = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select count(*) n, count(distinct user_id) users from events")
def agg_count_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(n_rows().alias("n"), F.count_distinct("user_id").alias("users"))


@query("select count(*) n, round(avg(try_cast(regexp_extract(props, '([0-9]+)', 1) as double)), 2) rating from events")
def agg_avg_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a number that is stored as text; what is no number is left out."""
    return table(spark, sf_dir, "events").agg(n_rows().alias("n"), F.round(F.avg(F.get_json_object("props", "$.k").try_cast("double")), 2).alias("rating"))


@query("""with d as (select ts::date::varchar as day, count(*) n from events where event_type != 'error' and user_id <= 100 and ts >= timestamp '2024-01-10' group by 1)
select coalesce(day, 'total') as day, sum(n)::bigint n from d group by rollup (day)""")
def agg_usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use by day of some users since a date, and the grand total."""
    e = table(spark, sf_dir, "events").where("event_type != 'error' and user_id <= 100 and ts >= timestamp_ntz '2024-01-10 00:00:00'")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(n_rows().alias("n")).rollup("day").agg(F.sum("n").alias("n")).select(F.coalesce("day", F.lit("total")).alias("day"), "n")


METRICS = """with m as (select *, row_number() over (order by value) - 1 i from events where value > 0), n as (select count(*) n from m), p as (select max(value) p95 from m, n where i = least(floor(0.95 * n), n - 1))
select count(*) n, min(ts) first_ts, max(ts) last_ts, round(avg(value) filter (value > 0), 6) avg_value, any_value(p95) p95, round(avg((event_type = 'purchase')::int), 6) pass_rate,
round(avg((event_type = 'error')::int), 6) refuse_rate, round(sum(value), 3) cost, sum((event_type = 'view')::int)::bigint hits from events, p"""


@query(METRICS)
def agg_metrics_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: times, mean and 95th percentile of positive values, rates, cost and hits."""
    e = table(spark, sf_dir, "events")
    kind = lambda k: (F.col("event_type") == k).cast("int")
    one = e.agg(
        n_rows().alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("avg_value"),
        F.round(mean(kind("purchase")), 6).alias("pass_rate"), F.round(mean(kind("error")), 6).alias("refuse_rate"), F.round(F.sum("value"), 3).alias("cost"), F.sum(kind("view")).alias("hits"),
    )
    p95 = scoring.nearest_rank_by_count(e.where("value > 0").withColumn("k", F.lit(1)), ["k"], "value", 0.95).select(F.col("value").alias("p95"))
    return one.join(F.broadcast(p95), how="cross")  # one row each


@query("""with w as (select date_trunc('week', ts)::date::varchar as week, avg(value) filter (event_type != 'error') m, count(*) n from events group by 1)
select week, n, round(coalesce(m, 0), 6) as mean_score, coalesce(m < lag(m) over (order by week), false) regression from w""")
def agg_weekly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean of judged events, and whether it fell."""
    w = table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week")).agg(F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("m"), n_rows().alias("n"))
    before = F.lag("m").over(Window.partitionBy().orderBy("week"))  # one row a week
    return w.select("week", "n", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_score"), F.coalesce(F.col("m") < before, F.lit(False)).alias("regression"))


@query("""with c as (select l_orderkey k, l_returnflag != 'R' supported, l_discount > 0.09 risky, l_linenumber from lineitem)
select k, round(avg(supported::int), 6) ratio, avg(supported::int) >= 0.8 and not bool_or(risky) grounded, coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber) filter (not supported), '') unsupported from c group by 1""")
def agg_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of supported claims of an answer, those unsupported, and whether it is grounded."""
    ok, risky = F.col("l_returnflag") != "R", F.col("l_discount") > 0.09
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(mean(ok.cast("int")).alias("r"), F.bool_or(risky).alias("risky"), F.sort_array(F.collect_list(F.when(~ok, F.col("l_linenumber")))).alias("u"))
    return g.select("k", F.round("r", 6).alias("ratio"), ((F.col("r") >= 0.8) & ~F.col("risky")).alias("grounded"), F.array_join("u", ",").alias("unsupported"))


FACTORS = """f as (select p_partkey k, unnest([p_size % 3, (p_size + length(p_name)) % 3, length(p_type) % 3]) v, unnest(['control', 'tools', 'chance']) factor from part)"""


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, factor, v (0 employee, 1 contractor, 2 ambiguous), one row a factor."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("a"), ((F.col("p_size") + F.length("p_name")) % 3).alias("b"), (F.length("p_type") % 3).alias("c"))
    return p.select("k", F.expr("stack(3, 'control', a, 'tools', b, 'chance', c) as (factor, v)"))


@query(f"""with {FACTORS}, s as (select k, sum((v = 0)::int) e, sum((v = 1)::int) c, max(v) filter (factor = 'control') control from f group by 1)
select k, case when e > c then 'employee' when c > e then 'contractor' when control = 1 then 'contractor' else 'employee' end label from s""")
def agg_factor_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side more factors speak for; a tie goes by the control factor."""
    n = lambda v: F.sum((F.col("v") == v).cast("int"))
    s = _factors(spark, sf_dir).groupBy("k").agg(n(0).alias("e"), n(1).alias("c"), F.max(F.when(F.col("factor") == "control", F.col("v"))).alias("control"))
    return s.select("k", F.when(F.col("e") > F.col("c"), "employee").when(F.col("c") > F.col("e"), "contractor").when(F.col("control") == 1, "contractor").otherwise("employee").alias("label"))


@query(f"""with {FACTORS} select k, round((sum((v = 0)::int) + 0.4 * sum((v = 2)::int)) / 10, 4)::double e, round((sum((v = 1)::int) + 0.4 * sum((v = 2)::int)) / 10, 4)::double c from f group by 1""")
def agg_factor_vote_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.sum((F.col("v") == v).cast("int"))
    side = lambda v: F.round((n(v) + 0.4 * n(2)) / 10, 4)
    return _factors(spark, sf_dir).groupBy("k").agg(side(0).alias("e"), side(1).alias("c"))


@query(f"""with {FACTORS}, a as (select factor, avg((v = 0)::int) e, avg((v = 1)::int) c, count(*) visits from f group by 1)
select factor, visits, round(e, 6) e, round(c, 6) c, case when e - c > 0.1 then 'employee' when c - e > 0.1 then 'contractor' else 'neutral' end lean from a""")
def agg_factor_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each factor's mean for both sides, its visits, and its lean beyond 0.1."""
    a = _factors(spark, sf_dir).groupBy("factor").agg(mean((F.col("v") == 0).cast("int")).alias("e"), mean((F.col("v") == 1).cast("int")).alias("c"), n_rows().alias("visits"))
    d = F.col("e") - F.col("c")
    return a.select("factor", "visits", F.round("e", 6).alias("e"), F.round("c", 6).alias("c"), F.when(d > 0.1, "employee").when(d < -0.1, "contractor").otherwise("neutral").alias("lean"))


@query("""with s as (select l_suppkey k, sum(l_discount * greatest(l_quantity, 1)) / sum(greatest(l_quantity, 1)) a, sum(l_tax * greatest(l_quantity, 1)) / sum(greatest(l_quantity, 1)) b from lineitem group by 1)
select k, case when a >= b then 'employee' else 'contractor' end label, round(greatest(a, b) / (a + b + 1e-8::double), 6) confidence from s""")
def agg_visit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores weighted by visits (none counts as one), the greater side and its confidence."""
    w = F.greatest("l_quantity", F.lit(1.0))
    side = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(side("l_discount").alias("a"), side("l_tax").alias("b"))
    return s.select("k", F.when(F.col("a") >= F.col("b"), "employee").otherwise("contractor").alias("label"), F.round(F.greatest("a", "b") / (F.col("a") + F.col("b") + 1e-8), 6).alias("confidence"))


@query("""with p as (select l_returnflag k, l_discount a, l_tax b, a - b d from lineitem)
select k, round(avg(d), 6) bias, round(stddev_samp(d), 6) spread, round(1 - least(1, stddev_samp(d) / 0.1), 6) confidence from p group by 1""")
def agg_bias_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of scores by order of presentation, its spread and a confidence held within 0 and 1."""
    d = F.col("l_discount") - F.col("l_tax")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return g.select("k", F.round("m", 6).alias("bias"), F.round("s", 6).alias("spread"), F.round(1 - F.least(F.lit(1.0), F.col("s") / 0.1), 6).alias("confidence"))


AUDIT = """s as (select l_linestatus k, greatest(0, avg(l_discount) filter (l_returnflag = 'A') - avg(l_discount) filter (l_returnflag != 'A')) own, abs(avg(l_discount - l_tax)) pos from lineitem group by 1)"""


@query(f"""with {AUDIT} select k, round(own, 6) self_bias, round(pos, 6) position_bias, round((own + pos) / 2, 6) magnitude, case when (own + pos) / 2 > 0.15 then 'mitigate' else 'ok' end advice from s""")
def agg_bias_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-enhancement (never below 0), position bias, their mean, and advice above 0.15."""
    own = F.col("l_returnflag") == "A"
    d = F.avg(F.when(own, F.col("l_discount"))) - F.avg(F.when(~own, F.col("l_discount")))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("k")).agg(F.greatest(F.lit(0.0), d).alias("own"), F.abs(F.avg(F.col("l_discount") - F.col("l_tax"))).alias("pos"))
    m = (F.col("own") + F.col("pos")) / 2
    return s.select("k", F.round("own", 6).alias("self_bias"), F.round("pos", 6).alias("position_bias"), F.round(m, 6).alias("magnitude"), F.when(m > 0.15, "mitigate").otherwise("ok").alias("advice"))


@query("select label::varchar namespace, count(*) n, min(vec_id) first_id from embeddings group by 1")
def agg_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("namespace")).agg(n_rows().alias("n"), F.min("vec_id").alias("first_id"))


@query("""with r as (select user_id, lag(ts) over (partition by user_id, event_type order by ts, event_id) before, ts from events)
select user_id, count(*) asked, sum((before is not null and epoch_us(ts) - epoch_us(before) <= 86400000000)::int)::bigint hits, round(avg((before is not null and epoch_us(ts) - epoch_us(before) <= 86400000000)::int), 3) hit_rate from r group by 1""")
def agg_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of a cache: an event is a hit where its user's last of that kind is within the time to live."""
    r = E.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], 86_400)
    return r.groupBy("user_id").agg(n_rows().alias("asked"), F.sum(F.col("hit").cast("int")).alias("hits"), F.round(mean(F.col("hit").cast("int")), 3).alias("hit_rate"))


@query("select user_id, sum((event_type in ('view', 'click'))::int)::bigint active, count(*) n, sum((event_type in ('view', 'click'))::int) < 3 may_submit from events group by 1")
def agg_active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each user that are queued or running, and whether one more may come."""
    active = F.sum(F.col("event_type").isin("view", "click").cast("int"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(active.alias("active"), n_rows().alias("n"), (active < 3).alias("may_submit"))


@query("""with r as (select *, row_number() over (partition by trim(lower(coalesce(text, ''))) order by doc_id) r from documents) select doc_id from r where r = 1""")
def win_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, whatever its case; a minimum combines before the shuffle."""
    key = F.sha2(F.trim(F.lower(F.coalesce("text", F.lit("")))), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("select conv_id, turn, role, row_number() over (partition by conv_id order by turn)::int place from conversations order by conv_id, turn")
def sort_messages_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", at.alias("place")).orderBy("conv_id", "turn")


@query("select l_partkey id from lineitem union select p_partkey from part")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).union(table(spark, sf_dir, "part").select("p_partkey")).distinct()


TIERS = "case user_id % 3 when 0 then 'free' when 1 then 'pro' else 'enterprise' end"


@query(f"""with e as (select event_id, user_id, ts, epoch_us(ts) t, {TIERS} tier from events),
c as (select *, count(*) over (partition by user_id order by t range between 86399999999 preceding and current row) n, min(t) over (partition by user_id order by t range between 86399999999 preceding and current row) oldest from e),
l as (select *, case tier when 'free' then 20 when 'pro' then 200 else 999999 end day_limit from c)
select event_id, tier, n, greatest(0, day_limit - n) remaining, case when n > day_limit then round((86400000000 - (t - oldest)) / 1e6, 3) end retry_after from l""")
def st_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with its user's of the day, what the tier leaves, and when to try again beyond it."""
    tier = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")), (F.col("user_id") % 3 + 1).cast("int"))
    limited = E.rate_limit(table(spark, sf_dir, "events").withColumn("tier", tier), 86_400, {"free": 20, "pro": 200, "enterprise": 999_999})
    return limited.select("event_id", "tier", "n", "remaining", F.round("retry_after", 3).alias("retry_after"))


@query(f"""with e as (select event_id, user_id, epoch_us(ts) t, {TIERS} tier from events),
c as (select *, count(*) over (partition by user_id order by t range between 59999999 preceding and current row) n from e)
select event_id, greatest(0, case tier when 'free' then 10 when 'pro' then 60 else 300 end - n) remaining from c""")
def st_quota_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the minute leaves of each tier's quota after a request."""
    tier = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")), (F.col("user_id") % 3 + 1).cast("int"))
    return E.rate_limit(table(spark, sf_dir, "events").withColumn("tier", tier), 60, {"free": 10, "pro": 60, "enterprise": 300}).select("event_id", "remaining")


@query("""with e as (select user_id, max(ts) last_ts, arg_max(event_type, ts) state from events group by 1), m as (select max(ts) now_ from events)
select user_id, state, epoch_us(now_) - epoch_us(last_ts) > 3600000000 expired from e, m""")
def st_ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each key and whether its hour is over at the end of the log."""
    e = table(spark, sf_dir, "events")
    return E.expired(e, "user_id", "event_type", 3600).select("user_id", "state", "expired")


@query("""with e as (select event_id, user_id, ts, case event_type when 'signup' then 'queued' when 'view' then 'running' when 'error' then 'error' else 'done' end state from events),
s as (select *, lead(state) over (partition by user_id order by ts, event_id) nxt from e) select state, coalesce(nxt, 'open') next_state, count(*) n from s group by 1, 2""")
def st_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each job state follows another in a user's log; the last stays open."""
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "error").otherwise("done")
    following = F.lead("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("state", state).select("state", F.coalesce(following, F.lit("open")).alias("next_state")).groupBy("state", "next_state").agg(n_rows().alias("n"))


@query("""with w as (select event_type, unnest(generate_series(0, 2)) o, time_bucket(interval 20 minute, ts) b from events)
select (b - o * interval 20 minute) as start, event_type, count(*) n, round(count(*) / 3600.0, 9)::double rate from w group by 1, 2""")
def st_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second over an hour that slides by twenty minutes."""
    m = E.windowed_metrics(table(spark, sf_dir, "events"), "1 hour", slide="20 minutes")
    return m.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("n") / 3600.0, 9).alias("rate"))


@query("""with f as (select source, lower(trim(coalesce(lang, ''))) q, d.doc_id, toxic, quality from documents d join labels l on d.doc_id = l.doc_id)
select source || '/' || q as question, count(*) wrong, min(doc_id) first_doc, sum((quality = 0)::int)::bigint incomplete, sum((coalesce(quality, 1) = 1)::int)::bigint hallucination, array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') comments
from f where toxic = 1 group by 1 having count(*) >= 3""")
def agg_flagged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered wrongly three times or more: the first, kinds of errors, and five comments at most.

    The five least ids come from partial minima, so no group is gathered whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.lower(F.trim(F.coalesce("lang", F.lit(""))))).alias("question"))
    bad = d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    g = bad.groupBy("question").agg(n_rows().alias("wrong"), F.min("doc_id").alias("first_doc"), F.sum((F.col("quality") == 0).cast("int")).alias("incomplete"), F.sum((F.coalesce("quality", F.lit(1)) == 1).cast("int")).alias("hallucination")).where("wrong >= 3")
    rank = F.row_number().over(Window.partitionBy("question").orderBy("doc_id"))
    five = bad.select("question", "doc_id", rank.alias("r")).where("r <= 5").groupBy("question").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("comments"))
    return g.join(five, "question")


@query("""with f as (select d.doc_id, case when toxic = 1 then 'hallucination' when quality = 0 then 'incomplete' else 'off_topic' end e from documents d join labels l on d.doc_id = l.doc_id where not (coalesce(quality, 0) = 1 and coalesce(toxic, 0) = 0)),
g as (select case e when 'hallucination' then 'generation_layer' else 'retrieval_layer' end layer, e error_type, count(*) n from f group by 1, 2), s as (select *, sum(n) over (partition by layer) / sum(n) over () share from g)
select layer, error_type, n, round(share, 6) share, case when share > 0.4 then 'improve ' || layer else '' end recommendation from s""")
def agg_root_cause_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative feedback by layer and error type, with advice where a layer has more than 0.4 of it."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id").where("not (coalesce(quality, 0) = 1 and coalesce(toxic, 0) = 0)")
    kind = F.when(F.col("toxic") == 1, "hallucination").when(F.col("quality") == 0, "incomplete").otherwise("off_topic")
    layer = F.when(F.col("error_type") == "hallucination", "generation_layer").otherwise("retrieval_layer")
    g = d.select(kind.alias("error_type")).groupBy("error_type").agg(n_rows().alias("n")).withColumn("layer", layer)
    share = F.sum("n").over(Window.partitionBy("layer")) / F.sum("n").over(Window.partitionBy())  # three rows
    return g.withColumn("s", share).select("layer", "error_type", "n", F.round("s", 6).alias("share"), F.when(F.col("s") > 0.4, F.concat(F.lit("improve "), "layer")).otherwise("").alias("recommendation"))


@query("select conv_id, turn, case when contains(lower(text), 'independent contractor') then 'Independent Contractor' when contains(lower(text), 'employee') then 'Employee' else 'Unknown' end predicted, length(text) - length(replace(text, '?', '')) marks from conversations where text is not null")
def text_predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", L.predicted_class(F.col("text")).alias("predicted"), (F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))).cast("bigint").alias("marks"))


@query(r"""with p as (select doc_id, regexp_extract_all(coalesce(text, ''), '\d{4}\s+[A-Z]{2,6}\s+\d+') c, coalesce(text, '') t from documents)
select doc_id, len(list_distinct(c))::int citations, case when contains(lower(t), 'supreme court') then 'supreme' when contains(lower(t), 'court of appeal') then 'appeal' when contains(lower(t), 'superior court') then 'superior'
when contains(lower(t), 'divisional court') then 'divisional' when contains(lower(t), 'small claims') then 'small_claims' when contains(lower(t), 'tribunal') then 'tribunal' end court_level,
regexp_matches(t, '(?i)\b(ISSUES?)\b') has_issues from p""")
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, court level and sections of whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", L.metadata(F.col("text")).alias("m"))
    return d.select("doc_id", F.size("m.citations").alias("citations"), "m.court_level", F.array_contains("m.sections", "issues").alias("has_issues"))
