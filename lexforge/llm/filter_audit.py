"""How filters interact: what each removes under every order in which they could run.

A document is known by the set of filters it fails (a mask), so all that matters of a part is its cells: at most 32
masks with counts of documents, good and toxic ones. Each cell folds across the array of all orders (120 of five
filters) with ``transform`` and ``aggregate``, which gives one struct a step, 600 in all, weighted with the cell's
counts; the structs of a part's cells are merged by elementwise sums. No document is read twice and no order is run.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def mask_of(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the failures that a text shows by itself: A under 50 words, B words that repeat (100 *
    distinct < 65 * words), C over 5 in a hundred signs A-Z, D one of ``#$%&*|``."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    # The lambda binds the words, so that a text is split once.
    short_or_same = F.transform(F.array(words), lambda w: F.when(F.size(w) < 50, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 2).otherwise(0))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return short_or_same + F.when(100 * capitals.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n, how many documents: rows of ``docs(doc_id, text, source)``, folded where alike.

    A null text is empty, a null source the empty part. E (bit 16) is failed by a row whose text some row with a
    smaller doc_id has, null ids neither failing it nor being smaller; copies under one doc_id share their fate. Texts
    are the same if their SHA-256 is. Only the row of a text's least doc_id passes, so rows are joined on digest and
    doc_id, which no hot text fills. ``labels`` that repeat count if one of them says so; rows without doc_id have
    none. Long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask_of(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    held = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    held = held.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    rest = rows.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return held.unionByName(rest)


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row a part, order of ``letters`` and step, zeros included, from ``rows(part, mask, good, toxic, n)``.

    Bit k of ``mask`` is the failure of letter k. kept counts documents after the step; removed those its filter takes
    here; redundant those that fail it and went earlier; unique_fails those that fail nothing else; good_lost and
    toxic_lost labelled ones removed here; shapley is what the filter removes, summed over all orders. Orders grow
    with the factorial of the letters: six give 4,320 structs a part.
    """
    size = len(letters)
    orders = list(permutations(range(size)))
    array = F.array(*[F.array(*[F.lit(1 << k) for k in o]) for o in orders])
    names = F.array(*[F.lit("".join(letters[k] for k in o)) for o in orders])
    sum_if = lambda flag, n: F.sum(F.when(flag, n).otherwise(0))
    n = F.col("n")
    cells = rows.groupBy("part", "mask").agg(F.sum(n).alias("n"), sum_if(F.col("good"), n).alias("good"), sum_if(F.col("toxic"), n).alias("toxic"))
    # At most 2 ** size cells a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("*", array.alias("orders"))
    steps = f"""transform(orders, o -> aggregate(o,
        named_struct('gone', false, 'steps', cast(array() as array<struct<{", ".join(f"{c}: bigint" for c in COUNTS)}>>)),
        (seen, f) -> named_struct('gone', seen.gone or (c.mask & f) > 0, 'steps', concat(seen.steps, array(named_struct(
            'kept', if(seen.gone or (c.mask & f) > 0, 0L, c.n),
            'removed', if(not seen.gone and (c.mask & f) > 0, c.n, 0L),
            'redundant', if(seen.gone and (c.mask & f) > 0, c.n, 0L),
            'unique_fails', if(c.mask = f, c.n, 0L),
            'good_lost', if(not seen.gone and (c.mask & f) > 0, c.good, 0L),
            'toxic_lost', if(not seen.gone and (c.mask & f) > 0, c.toxic, 0L))))),
        seen -> seen.steps))"""
    zero = f"array_repeat(named_struct({', '.join(f'{c!r}, 0L' for c in COUNTS)}), {size * len(orders)})"
    add = f"named_struct({', '.join(f'{c!r}, x.{c} + y.{c}' for c in COUNTS)})"
    merged = parts.select("part", "orders", F.expr(f"aggregate(cells, {zero}, (sums, c) -> zip_with(sums, flatten({steps}), (x, y) -> {add}))").alias("steps"))
    total = "aggregate(zip_with(flatten(orders), steps, (f, s) -> if(f = b, s.removed, 0L)), 0L, (x, y) -> x + y)"
    totals = merged.select("part", "orders", "steps", F.expr(f"transform(array({', '.join(str(1 << k) for k in range(size))}), b -> {total})").alias("totals"))
    told = totals.select("part", "totals", F.posexplode(F.expr("zip_with(flatten(orders), steps, (f, s) -> named_struct('f', f, 's', s))")).alias("at", "x"))
    letter = F.log2(F.col("x.f").cast("double")).cast("int")
    place = F.col("at")
    return told.select("part", F.element_at(names, (F.floor(place / size) + 1).cast("int")).alias("filter_order"), (place % size + 1).cast("int").alias("step"), *[F.col(f"x.s.{c}").alias(c) for c in COUNTS], F.element_at("totals", letter + 1).alias("shapley"))
