"""Query classification, search-tree scores, evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import count_patterns, count_phrases, lower_tokens, word_count

# Marks of exact, of open and of complex questions, and the weights of word and vector scores.
KEYWORD_PATTERNS = [
    r"\d{4}\s+[A-Z]{2,6}\s+\d+",
    r"\b[Ss]\.?\s*\d+",
    r"\b[Ss]ection\s+\d+",
    r"\bESA\b|\bOHSA\b|\bCLC\b|\bSCC\b",
    r"\bAct\b.*\b\d{4}\b",
    r"\b[A-Z][a-z]+\s+v\.?\s+[A-Z][a-z]+",
]
SEMANTIC_PHRASES = [
    "what factors", "how does", "explain", "describe", "what is the difference", "compare", "relationship between",
    "what are", "why is", "when should", "in what circumstances", "what considerations", "how to determine",
]
COMPLEX_PHRASES = [
    "and also", "in addition", "compared to", "versus", "how does", "what are all", "comprehensive", "multiple",
    "different", "interact", "relationship between", "both", "as well as", "furthermore", "across",
]
WEIGHTS = {"keyword": (0.7, 0.3), "semantic": (0.2, 0.8), "hybrid": (0.4, 0.6)}


def query_class(text: Column) -> Column:
    kw, sem = count_patterns(text, [f"(?i){p}" for p in KEYWORD_PATTERNS]), count_phrases(text, SEMANTIC_PHRASES)
    return F.when((kw >= 2) | ((kw >= 1) & (sem == 0)), "keyword").when((sem >= 2) | ((sem >= 1) & (kw == 0)), "semantic").otherwise("hybrid")


def query_weights(kind: Column) -> tuple[Column, Column]:
    pick = lambda i: F.when(kind == "keyword", WEIGHTS["keyword"][i]).when(kind == "semantic", WEIGHTS["semantic"][i]).otherwise(WEIGHTS["hybrid"][i])
    return pick(0), pick(1)


def is_complex(text: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return (count_phrases(text, COMPLEX_PHRASES) >= 2) | (word_count(text) > 40) | (marks > 1)


def ucb1(reward: Column, visits: Column, parent_visits: Column, c: float = 1.414) -> Column:
    """Mean reward and an allowance for few visits; unvisited nodes come first."""
    bonus = F.lit(c) * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1)).cast("double")) / visits)
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(reward / visits + bonus)


def evidence_heuristic(evidence: Column, question: Column) -> Column:
    """Share of the question's longer words found in the evidence, and how many pieces there are."""
    terms = F.filter(lower_tokens(question), lambda t: F.length(t) > 3)
    text = F.lower(F.array_join(evidence, " "))
    n, hits = F.size(terms), F.size(F.filter(terms, lambda t: F.contains(text, t)))
    pieces = F.least(F.lit(1.0), F.size(evidence) / 3.0)
    return F.when(n == 0, pieces).otherwise(0.7 * hits / F.greatest(n, F.lit(1)) + 0.3 * pieces)


def nearest_rank_by_count(df: DataFrame, by: list[str], value: str, p: float, ranges: int = 256) -> DataFrame:
    """Element floor(p n), at most the last, of the sorted non-null values of each group, of any size.

    Values are counted by range between the group's least and greatest; the range that holds the rank is found from
    ``ranges`` counts, and only its values are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = rows.join(ends, by).withColumn("_cell", F.least(F.floor(share * ranges), F.lit(ranges - 1)))
    cells = placed.groupBy(*by, "_cell", "_n").agg(F.count(F.lit(1)).alias("_c"))
    ahead = F.sum("_c").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    target = F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1)
    wanted = cells.withColumn("_ahead", ahead).where((F.col("_ahead") <= target) & (target < F.col("_ahead") + F.col("_c"))).select(*by, "_cell", (target - F.col("_ahead")).alias("_at"))
    counts = placed.join(wanted, [*by, "_cell"]).groupBy(*by, "_at", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_upto", upto).where("_upto > _at").groupBy(*by).agg(F.min("_v").alias(value))


def feedback_summary(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of ``df(rating, error_type, at)`` a group: rows, shares of useful and wrong, how many ratings and error types of
    each kind (as sorted text), and ``at`` of its first and last row by ``order``. Kinds are few."""
    whole = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("rating") == "useful").cast("double")), 3).alias("useful_rate"),
        F.round(F.avg((F.col("rating") == "wrong").cast("double")), 3).alias("wrong_rate"),
        F.min_by("at", order).alias("earliest"),
        F.max_by("at", order).alias("latest"),
    )
    for kind, name in (("rating", "ratings"), ("error_type", "error_types")):
        counts = df.where(F.col(kind).isNotNull()).groupBy(*by, kind).agg(F.count(F.lit(1)).alias("_n"))
        text = counts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", kind, F.col("_n").cast("string")))), ",").alias(name))
        whole = whole.join(text, by, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return whole


def pairwise(df: DataFrame, by: list[str], margin: float = 0.05) -> DataFrame:
    """Means and sample deviations of both sides a and b, the winner (tie within the margin), and confidence: how
    consistent the sides are times five times their distance, within 0 and 1; of one row the distance itself."""
    m = df.groupBy(*by).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.stddev_samp("a").alias("std_a"), F.stddev_samp("b").alias("std_b"), F.count(F.lit(1)).alias("n"))
    d = F.col("mean_a") - F.col("mean_b")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - (F.col("std_a") + F.col("std_b")) / 2) * F.abs(d) * 5))
    return m.withColumn("winner", F.when(F.abs(d) < margin, "tie").when(d > 0, "a").otherwise("b")).withColumn("confidence", F.when(F.col("n") > 1, sure).otherwise(F.abs(d)))


def verbosity_penalty(words: Column, most: int = 500, slack: float = 1.2) -> Column:
    """1 up to ``most`` words, then their share times ``slack``, at most 1."""
    return F.when(words > most, F.least(F.lit(1.0), most / words * slack)).otherwise(F.lit(1.0))


def histogram_quantile(within: list[Column], total: Column, bounds: list[float], q: float) -> Column:
    """The q-quantile of a histogram: linear within its bucket, the last bound beyond it, null of none.

    ``within`` are the numbers of values up to each of ``bounds``.
    """
    rank, found = total * q, F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, ahead = (float(bounds[i - 1]), within[i - 1]) if i else (0.0, F.lit(0))
        at = F.lit(low) + F.lit(float(bounds[i]) - low) * F.try_divide(rank - ahead, within[i] - ahead)
        found = F.when(within[i] >= rank, at).otherwise(found)
    return found
