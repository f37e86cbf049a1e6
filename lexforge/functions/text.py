"""Text expressions: tokens, overlaps, pattern extraction and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words with inner hyphens and dots.
TOKEN = r"(?U)\b[\w\-\.]+\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, though lambdas in the body use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_tokens(text: Column) -> Column:
    """Lower-cased words, with inner hyphens and dots."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Words by white space; blank or null text has none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def simple_words(text: Column) -> Column:
    """Distinct lower-cased words by single spaces and line ends."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \n]")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union that two arrays have in common; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has; 0 for an empty query."""
    n = F.size(F.array_distinct(query))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)) / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null when either has no length."""
    dot = dot_product(a, b)
    norm = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
    return F.when(norm > 0, dot / norm)


def dot_product(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(pair, F.lit(0.0), lambda s, x: s + x))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def excerpt(text: Column, n: int = 500) -> Column:
    """The first n characters, with dots when more follow."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, white space folds."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    """Distinct href targets in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))


def count_phrases(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def count_patterns(text: Column, patterns: list[str]) -> Column:
    return sum((F.coalesce(text, F.lit("")).rlike(p).cast("int") for p in patterns), F.lit(0))
