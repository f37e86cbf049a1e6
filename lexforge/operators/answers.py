"""Answers and their evidence: confidence gate, federated fusion, stopping of retrieval hops, costs, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import legal
from lexforge.functions.text import word_count
from lexforge.operators.ranking import gate

# Words that say nothing about an answer's support.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has",
    "this", "that", "with", "have", "from", "they", "been", "said", "each", "which", "their", "will", "other",
    "about", "would", "these", "than", "its", "also",
)
#: US dollars for a thousand tokens.
EMBEDDING_COST, GENERATION_COST = 0.00002, 0.000075


def plain_words(text: Column) -> Column:
    """Distinct lower-cased words of three or more letters a-z."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$")))


def support(answer: Column, sources: Column) -> Column:
    """Share of an answer's words that its sources have; 0 without sources, 1 for an answer of no words."""
    theirs = plain_words(sources)
    ours = F.array_except(plain_words(answer), F.array(*map(F.lit, STOP_WORDS)))
    share = F.size(F.array_intersect(ours, theirs)) / F.greatest(F.size(ours), F.lit(1))
    return F.when(F.size(theirs) == 0, 0.0).when(F.size(ours) == 0, 1.0).otherwise(share)


def citation_accuracy(answer: Column, sources: Column) -> Column:
    """Share of the answer's citations that its sources hold; null where it cites nothing."""
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(legal.CITATION), F.lit(0)))
    low = F.lower(F.coalesce(sources, F.lit("")))
    found = F.size(F.filter(cited, lambda c: F.contains(low, F.lower(c))))
    return F.when(F.size(cited) > 0, found / F.size(cited))


def confidence(answers: DataFrame) -> DataFrame:
    """Adds support, citations and action to ``answers(answer, sources)``."""
    rated = answers.withColumn("support", support(F.col("answer"), F.col("sources")))
    rated = rated.withColumn("citations", citation_accuracy(F.col("answer"), F.col("sources")))
    return rated.withColumn("action", gate(F.col("support"), F.col("citations")))


def federate(sources: list[DataFrame]) -> DataFrame:
    """Results of several sources (id, url, score, source_type), the best of each address.

    Rows without an address count by id. A maximum is combined before the shuffle, so a result that
    many sources return is no hot group.
    """
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    names = ["id", "url", "score", "source_type"]
    key = F.coalesce(F.nullif("url", F.lit("")), F.col("id"))
    best = every.groupBy(key.alias("key")).agg(F.max_by(F.struct(*names), F.struct("score", "source_type", "id")).alias("r"))
    return best.select("r.*")


def stop_reason(hops: DataFrame, enough: float = 0.8, least_words: int = 50, gain: float = 0.05) -> DataFrame:
    """Why retrieval stops at each hop, null where it goes on.

    ``hops(query_id, hop, completeness, n_gaps, new_words)``, hop from 1; the first reason in order counts.
    """
    before = F.lag("completeness").over(Window.partitionBy("query_id").orderBy("hop"))
    reason = (
        F.when(F.col("completeness") >= enough, "complete")
        .when(F.col("n_gaps") == 0, "no_gaps")
        .when((F.col("hop") > 1) & (F.col("new_words") < least_words), "little_new")
        .when(F.col("completeness") <= before + gain, "plateau")
    )
    return hops.withColumn("reason", reason)


def until_stop(hops: DataFrame) -> DataFrame:
    """Hops up to and with the first that has a reason to stop."""
    first = hops.where("reason is not null").groupBy("query_id").agg(F.min("hop").alias("stop"))
    return hops.join(first, "query_id", "left").where("stop is null or hop <= stop").drop("stop")


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Estimated dollars of one query."""
    return tokens_in / 1000 * EMBEDDING_COST + (tokens_in + tokens_out) / 1000 * GENERATION_COST


def length_penalty(text: Column) -> Column:
    """1 up to 500 words, then 600 words over the number of words, at most 1."""
    n = word_count(text)
    return F.when(n > 500, F.least(F.lit(1.0), 600.0 / n)).otherwise(F.lit(1.0))


def reward(scores: Column, weights: dict[str, float], missing: float = 0.5) -> Column:
    """Weighted sum over a map of scores; a missing one counts ``missing``."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(missing))
    return total


# How the judge's scores weigh.
REWARD_WEIGHTS = {"precedent_alignment": 0.35, "factor_completeness": 0.25, "logical_consistency": 0.25, "evidence_strength": 0.15}


def source_block(rows: DataFrame, by: list[str], place: Column, name: Column, text: Column, signs: int = 300) -> DataFrame:
    """A group's sources as one text, by ``place``: its number, its name, and the first ``signs`` of its text. Groups are
    result lists, cut before."""
    one = F.concat(F.lit("[Source "), place, F.lit("] "), F.coalesce(name, F.lit("Unknown")), F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(signs)))
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), one.alias("t")))).alias("r"))
    return held.select(*by, F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("block"))


def events_of(text: Column, n: int = 3) -> Column:
    """Pieces of ``n`` words, as an answer is sent word by word."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")
    pieces = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(n)), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) > 0, pieces).otherwise(F.array().cast("array<string>"))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Nulls of a column become its most frequent value (the smallest of tied ones), else Unknown."""
    mode = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)
    one = mode.agg(F.max(column).alias("_mode"))  # one row
    return df.join(F.broadcast(one), how="cross").withColumn(column, F.coalesce(column, "_mode", F.lit("Unknown"))).drop("_mode")


def ml_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy, and precision, recall and F1 weighted by class, from the counts of the confusion matrix."""
    cells = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    true = cells.groupBy("y").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = cells.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("said"))
    per = true.join(said, "y", "left").withColumn("precision", F.coalesce(F.try_divide("tp", "said"), F.lit(0.0))).withColumn("recall", F.col("tp") / F.col("support"))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def least_recent(events: DataFrame, key: str, size: int) -> DataFrame:
    """Each key with its last access and whether a cache of ``size`` entries has evicted it."""
    last = events.groupBy(key).agg(F.max("ts").alias("last"))
    kept = last.orderBy(F.desc("last"), key).limit(size).select(key, F.lit(False).alias("kept_out"))
    return last.join(kept, key, "left").select(key, "last", F.coalesce("kept_out", F.lit(True)).alias("evicted"))
