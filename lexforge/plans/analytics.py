"""Registered queries: usage, feedback, evaluation, windows, graphs, trees and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import answers as A
from lexforge.operators import classifier, filters, graph, scoring
from lexforge.session import cut, table
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


@query("select ts::date::varchar as day, event_type, count(*) n from events where event_type != 'error' group by 1, 2")
def agg_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type != 'error'")
    return e.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type, count(*) n, round(avg(value) filter (value > 0), 6) avg_value, round(sum(value), 4) total,
round(sum((value > 50)::int) / count(*), 6) high_rate from events group by 1""")
def agg_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(v > 0, v)), 6).alias("avg_value"),
        F.round(F.sum(v), 4).alias("total"),
        F.round(F.sum((v > 50).cast("int")) / F.count(F.lit(1)), 6).alias("high_rate"),
    )


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events where value is not null)
select event_type, value p95 from r where i = least(floor(0.95 * n), n - 1)""")
def agg_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.nearest_rank_by_count(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95).withColumnRenamed("value", "p95")


@query("""with e as (select user_id, event_id, value from events order by value, event_id limit 20) select * from e""")
def agg_worst_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value").orderBy("value", "event_id").limit(20)


FEEDBACK = """f as (select d.doc_id, source, case when toxic = 1 then 'wrong' when quality = 1 then 'useful' else 'partial' end rating
from documents d join labels l on d.doc_id = l.doc_id)"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    rating = F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 1, "useful").otherwise("partial")
    return docs.join(labels, "doc_id").select("doc_id", "source", rating.alias("rating"))


@query(f"""with {FEEDBACK}, e as (select *, case when rating = 'wrong' then case when doc_id % 2 = 0 then 'hallucination' else 'outdated' end when rating = 'partial' then 'incomplete' end error_type from f),
r as (select source, string_agg(rating || ':' || n, ',' order by rating || ':' || n) ratings from (select source, rating, count(*) n from e group by all) group by 1),
x as (select source, string_agg(error_type || ':' || n, ',' order by error_type || ':' || n) error_types from (select source, error_type, count(*) n from e where error_type is not null group by all) group by 1)
select e.source, count(*) n, round(avg((rating = 'useful')::int), 3) useful_rate, round(avg((rating = 'wrong')::int), 3) wrong_rate, min(doc_id) earliest, max(doc_id) latest, any_value(ratings) ratings, coalesce(any_value(error_types), '') error_types
from e left join r on r.source = e.source left join x on x.source = e.source group by 1""")
def agg_feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback by source: rates, ratings and error types, and the first and last entry."""
    kind = F.when(F.col("rating") == "wrong", F.when(F.col("doc_id") % 2 == 0, "hallucination").otherwise("outdated")).when(F.col("rating") == "partial", "incomplete")
    return scoring.feedback_summary(_feedback(spark, sf_dir).withColumn("error_type", kind).withColumn("at", F.col("doc_id")), ["source"], "doc_id")


@query(f"""with {FEEDBACK} select source, count(*) wrong, min(doc_id) first_doc from f where rating = 'wrong' group by 1 having count(*) >= 3""")
def agg_flagged_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _feedback(spark, sf_dir).where("rating = 'wrong'")
    return bad.groupBy("source").agg(F.count(F.lit(1)).alias("wrong"), F.min("doc_id").alias("first_doc")).where("wrong >= 3")


@query(f"""with {FEEDBACK}, l as (select case rating when 'wrong' then 'retrieval' when 'partial' then 'generation' else 'none' end layer from f)
select layer, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from l group by 1""")
def agg_root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("rating") == "wrong", "retrieval").when(F.col("rating") == "partial", "generation").otherwise("none")
    g = _feedback(spark, sf_dir).groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("layer", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # three rows


@query("select source, lang, count(*) n from documents group by rollup (source, lang)")
def agg_benchmark_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""with d as (select doc_id, quality::double q, 1.0 - toxic s, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w != '')) n from documents join labels using (doc_id)),
p as (select *, case when n > 500 then least(1.0, 500.0 / n * 1.2) else 1.0 end::double p from d)
select doc_id, round((q * 0.6 * p + s * 0.4 * p) / 1.0, 4)::double overall from p where q is not null and s is not null""")
def agg_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component scores weighted and held down for texts of many words."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null and toxic is not null")
    penalty, weights = scoring.verbosity_penalty(T.word_count(F.col("text"))), {"quality": 0.6, "safety": 0.4}
    scores = {"quality": F.col("quality").cast("double"), "safety": 1.0 - F.col("toxic")}
    return d.select("doc_id", F.round(sum((scores[c] * w * penalty for c, w in weights.items()), F.lit(0.0)) / sum(weights.values()), 4).alias("overall"))


@query("""with m as (select l_shipmode_key k, avg(l_discount) mean_a, avg(l_tax * 4) mean_b, stddev_samp(l_discount) std_a, stddev_samp(l_tax * 4) std_b, count(*) n from (select *, l_returnflag || l_linestatus l_shipmode_key from lineitem) group by 1)
select k, round(mean_a, 6) mean_a, round(mean_b, 6) mean_b, round(std_a, 6) std_a, round(std_b, 6) std_b, case when abs(mean_a - mean_b) < 0.05 then 'tie' when mean_a > mean_b then 'a' else 'b' end winner,
round(case when n > 1 then greatest(0.0, least(1.0, (1 - (std_a + std_b) / 2) * abs(mean_a - mean_b) * 5)) else abs(mean_a - mean_b) end::double, 6) confidence from m""")
def agg_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_discount").alias("a"), (F.col("l_tax") * 4).alias("b"))
    m = scoring.pairwise(rows, ["k"])
    return m.select("k", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "std_a", "std_b")], "winner", F.round("confidence", 6).alias("confidence"))


@query("select lang, round(coalesce(covar_pop(n_chars::double, quality::double) / nullif(stddev_pop(n_chars::double) * stddev_pop(quality::double), 0), 0), 6) r, count(*) n from documents join labels using (doc_id) group by 1")
def agg_bias_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    x, y = F.col("n_chars").cast("double"), F.col("quality").cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return d.groupBy("lang").agg(F.round(F.coalesce(r, F.lit(0.0)), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query("select quality, toxic, count(*) n from labels group by all")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select user_id, event_id, epoch_us(ts) t from events)
select user_id, event_id, count(*) over (partition by user_id order by t range between 86400000000 preceding and current row) n_trailing from e""")
def win_sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding_count(table(spark, sf_dir, "events"), 86400).select("user_id", "event_id", "n_trailing")


@query("""with e as (select event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 gap from events)
select event_id, coalesce(gap >= 3600, true) allowed from e""")
def win_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cooldown(table(spark, sf_dir, "events"), 3600).select("event_id", "allowed")


@query("""with f as (select user_id, ts, event_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 1800000000), true)::int f from events),
s as (select user_id, ts, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) session_no from f)
select user_id, session_no::bigint session_no, count(*) n from s group by 1, 2""")
def win_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events")).select("user_id", "session_no", "n")


@query("""with w as (select date_trunc('week', o_orderdate)::date::varchar as week, count(*) n, sum(round(o_totalprice * 100)::bigint)::double / count(*) / 100 mean from orders group by 1)
select week, n, round(mean, 6) mean, round(mean - lag(mean) over (order by week), 6) change from w""")
def win_week_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "o_orderdate")).cast("string").alias("week")
    w = table(spark, sf_dir, "orders").groupBy(week).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / F.count(F.lit(1)) / 100).alias("mean"))
    change = F.col("mean") - F.lag("mean").over(Window.partitionBy().orderBy("week"))  # one row a week
    return w.select("week", "n", F.round("mean", 6).alias("mean"), F.round(change, 6).alias("change"))


@query("""select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 5""")
def win_bounded_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("r", r).where("r <= 5").select("user_id", "event_id")


@query("""with heads as (select conv_id, min(turn) first_turn, arg_min(role, turn) opened_by from conversations group by 1)
select c.conv_id, turn, role, opened_by, turn - first_turn as since from conversations c join heads using (conv_id)""")
def join_inner_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their conversation: who opened it, and how many turns before."""
    c = table(spark, sf_dir, "conversations")
    heads = c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("opened_by"))
    return c.join(heads, "conv_id").select("conv_id", "turn", "role", "opened_by", (F.col("turn") - F.col("first_turn")).alias("since"))


@query("""select n_name, r_name, count(*) customers, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def join_lookup_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region have a fixed number of rows
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("b"))
    return c.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers", F.round("b", 2).alias("balance"))


@query("""select o_orderkey, o_orderdate::date::varchar as day from orders order by o_orderdate desc, o_orderkey limit 50 offset 100""")
def sort_recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50)
    return o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of suppliers, parts and nations: who supplies what, and who is where."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.concat(F.lit("p"), "l_partkey").alias("object")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("n"), "s_nationkey").alias("object"))
    return li.withColumn("relation", F.lit("SUPPLIES")).unionByName(s.withColumn("relation", F.lit("IS_IN")))


EDGES = """e as (select distinct 's' || l_suppkey s, 'p' || l_partkey o, 'SUPPLIES' relation from lineitem union all select 's' || s_suppkey, 'n' || s_nationkey, 'IS_IN' from supplier),
b as (select s, o from e union select o, s from e)"""


@query(f"""with {EDGES}, f0 as (select 's1' id), f1 as (select distinct o id from b where s in (select id from f0)),
f2 as (select distinct o id from b where s in (select id from f1))
select id, min(depth)::int depth from (select id, 0 depth from f0 union all select id, 1 from f1 union all select id, 2 from f2) group by 1""")
def kg_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "id string"), 2)


def _rank_sql(rounds: int) -> str:
    head = f"""with {EDGES}, n as (select distinct s id from b), c as (select count(*) c from n), deg as (select s, count(*) out from e group by 1),
base as (select id, out from n left join deg on id = s), r0 as (select id, out, 1.0::double / c score from base, c)"""
    for i in range(rounds):
        head += f""", g{i} as (select o id, sum(score / out) got from r{i} join e on id = s group by 1), l{i} as (select coalesce(sum(score) filter (out is null), 0) lost from r{i}),
r{i + 1} as (select base.id, base.out, 0.15 / c + 0.85 * (coalesce(got, 0) + lost / c) score from base left join g{i} using (id), l{i}, c)"""
    return head + f" select id, round(score, 8) score from r{rounds}"


@query(_rank_sql(12))
def kg_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("subject").alias("id")).union(edges.select("object")).distinct()
    return graph.pagerank(nodes, edges, tolerance=1e-12).select("id", F.round("score", 8).alias("score"))


@query(f"""with {EDGES}, d as (select o id, count(*) degree from e group by 1) select id, degree from d""")
def kg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(F.col("object").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@query(f"""{_rank_sql(12).replace("select id, round(score, 8) score from r12", "").replace("with e as", "with recursive e as")}, n1 as (select count(*) nodes from n), m as (select count(*) edges from e),
reached(id) as (select min(id) from n union select b.o from reached join b on b.s = reached.id), top as (select id, score, row_number() over (order by round(score, 9) desc, id) k from r12)
select nodes, edges, round(edges / (nodes * (nodes - 1.0::double)), 9) density, case when (select count(*) from reached) = nodes then 1 end::bigint components,
(select string_agg(id, ',' order by k) from top where k <= 5) top from n1, m""")
def agg_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: nodes, edges, density, weakly connected components and the five nodes of best rank."""
    edges = cut(_edges(spark, sf_dir))
    nodes = cut(edges.select(F.col("subject").alias("id")).union(edges.select("object")).distinct())
    best = graph.pagerank(nodes, edges, tolerance=1e-12).orderBy(F.desc(F.round("score", 9)), "id").limit(5)
    top = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.round("score", 9), "id"))), lambda x: x["id"]), ",").alias("top"))
    parts = graph.components(edges).agg(F.count_distinct("component").alias("components"))
    d = graph.density(nodes, edges).select("nodes", "edges", F.round("density", 9).alias("density"))
    return d.join(F.broadcast(parts), how="cross").join(F.broadcast(top), how="cross")  # one row each


@query(f"""with {EDGES}, r as (select relation, s || ' -> ' || o t, row_number() over (partition by relation order by s, o) r, count(*) over (partition by relation) n from e)
select relation, string_agg(t, '; ' order by t) text, any_value(n) n from r where r <= 10 group by 1""")
def kg_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.linearize(_edges(spark, sf_dir))


@query("""with t as (select c_nationkey node, count(*) visits, sum(greatest(c_acctbal, 0)) / 10000.0 reward, sum(count(*)) over () parent from customer group by 1)
select node, visits, round(reward / visits + 1.414 * sqrt(ln(greatest(parent, 1)::double) / visits), 6) ucb1 from t""")
def mcts_ucb1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("visits"), (F.sum(F.greatest("c_acctbal", F.lit(0.0))) / 10000.0).alias("reward"))
    t = t.withColumn("parent", F.sum("visits").over(Window.partitionBy()))  # one row a nation
    return t.select("node", "visits", F.round(scoring.ucb1(F.col("reward"), F.col("visits"), F.col("parent")), 6).alias("ucb1"))


@query()
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.cross_checked(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size_band")


def _trained(spark: SparkSession, sf_dir: str) -> classifier.Trained:
    """A forest for the quality of labelled documents by language, source, length and signs that prose seldom has."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null")
    odd = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^%$#*&]+", "")) * 100 / F.greatest(F.length("text"), F.lit(1))
    rows = d.join(y, "doc_id").select("doc_id", "lang", "source", F.floor(F.log2(F.col("n_chars") + 1)).alias("length"), F.least(F.floor(odd), F.lit(9)).alias("odd_signs"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality"))
    return classifier.train(rows, "doc_id", ["lang", "source", "length", "odd_signs"], "quality")


@query()
def rf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the grid chose, accuracy over folds, metrics on the held-out fifth and importances, as (name, value)."""
    t = _trained(spark, sf_dir)
    m = A.ml_metrics(t.test, "label", "predicted").first()
    told = [("cv_mean", t.cv_mean), ("cv_std", t.cv_std), *m.asDict().items(), *((k, float(v)) for k, v in t.chosen.items()), *((f"importance_{f}", w) for f, w in t.importances)]
    return spark.createDataFrame([(k, float(v)) for k, v in told if v is not None], "name string, value double")


@query()
def rf_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each held-out document's predicted class with the reasons that count most."""
    t = _trained(spark, sf_dir)
    return classifier.explained(t.test, t, {"good": "The document is likely sound", "bad": "The document is likely junk"}, "No class").select("doc_id", "predicted", F.round("confidence", 6).alias("confidence"), "explanation")


@query("""select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def agg_promql(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.windowed_metrics(table(spark, sf_dir, "events"))
    return m.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with m as (select time_bucket(interval 5 minute, ts) as start, event_type, count(*) n from events group by 1, 2),
r as (select *, n - lag(n) over (partition by event_type order by start) delta, row_number() over (partition by start order by n desc, event_type) top from m)
select start, event_type, n as increase, round(n / 300.0::double, 6) rate, delta, top::int as top from r where top <= 3""")
def agg_promql_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increase and rate in five minutes, the change to the type's window before, and the three busiest types of each.

    Events are counted first, so that a window function sees one row a type and five minutes.
    """
    m = E.windowed_metrics(table(spark, sf_dir, "events"), "5 minutes").select("start", "event_type", "n")
    delta = F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("start"))
    top = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), "event_type"))
    best = m.withColumn("delta", delta).withColumn("top", top).where("top <= 3")
    return best.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.col("n").alias("increase"), F.round(F.col("n") / 300.0, 6).alias("rate"), "delta", "top")


#: Upper ends of the histogram of event values, and the quantiles read from it.
BUCKETS, QUANTILES = [1.0, 5.0, 10.0, 50.0, 100.0, 250.0], [0.5, 0.95, 0.99]


@query(f"""with b(lo, le) as (values {", ".join(f"({lo}::double, {le}::double)" for lo, le in zip([0.0, *BUCKETS], BUCKETS))}),
h as (select event_type, lo, le, count(*) filter (value <= le) cum, count(*) filter (value <= lo and lo > 0) ahead, count(*) total from events, b where value is not null group by all),
q as (select unnest({QUANTILES}::double[]) q)
select event_type, q, round(coalesce(arg_min(lo + (le - lo) * (q * total - ahead) / (cum - ahead), le) filter (cum >= q * total), {BUCKETS[-1]}), 6)::double as value from h, q group by 1, 2""")
def agg_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of event values as read from bucket counts: one partially combined row a type."""
    v = F.col("value")
    h = table(spark, sf_dir, "events").where(v.isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), *[F.sum((v <= b).cast("bigint")).alias(f"h{i}") for i, b in enumerate(BUCKETS)])
    within = [F.col(f"h{i}") for i in range(len(BUCKETS))]
    at = [F.struct(F.lit(q).alias("q"), F.round(scoring.histogram_quantile(within, F.col("total"), BUCKETS, q), 6).alias("value")) for q in QUANTILES]
    return h.select("event_type", F.explode(F.array(*at)).alias("r")).select("event_type", "r.*")


@query("""with w as (select date_trunc('week', o_orderdate)::date::varchar as week, avg((o_orderstatus = 'F')::int) accuracy, sum(round(o_totalprice * 100)::bigint)::double / count(*) / 100 score from orders group by 1),
p as (select *, lag(accuracy) over (order by week) a, lag(score) over (order by week) s from w)
select week, round(accuracy - a, 4) accuracy_change, round(score - s, 4) score_change, accuracy < a as accuracy_regression, score < s as score_regression from p where a is not null""")
def win_week_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks against the week before: the changes of a share and of a mean, and whether either fell."""
    week = F.to_date(F.date_trunc("week", "o_orderdate")).cast("string").alias("week")
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / F.count(F.lit(1)) / 100
    w = table(spark, sf_dir, "orders").groupBy(week).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("accuracy"), mean.alias("score"))
    before = Window.partitionBy().orderBy("week")  # one row a week
    p = w.withColumn("a", F.lag("accuracy").over(before)).withColumn("s", F.lag("score").over(before)).where("a is not null")
    return p.select("week", F.round(F.col("accuracy") - F.col("a"), 4).alias("accuracy_change"), F.round(F.col("score") - F.col("s"), 4).alias("score_change"), (F.col("accuracy") < F.col("a")).alias("accuracy_regression"), (F.col("score") < F.col("s")).alias("score_regression"))
