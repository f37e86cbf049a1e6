"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every window of ``SPAN`` words holds ``SPAN - GRAM + 1`` grams of ``GRAM`` words; the gram of least
hash is its fingerprint. Equal windows keep equal fingerprints, so any shared span of ``SPAN`` words or
more shares one. Fingerprints of documents are joined with those of the benchmark, and each hit is
extended: all windows around it are compared with the benchmark's windows word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.rows import keys, sieve, without
from lexforge.session import cut

SPAN, GRAM = 10, 5
#: Words after A-Z are lowered: runs of letters a-z, digits and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark fingerprints and windows up to this number of bytes are broadcast; beyond it they are shuffled.
BROADCAST_BYTES = 128 << 20


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, though lambdas in the body use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprints(hashes: Column) -> Column:
    """Positions and hashes, as structs, of the grams kept by winnowing; ``hashes`` are of single words.

    Texts shorter than a window keep none.
    """
    width = SPAN - GRAM + 1

    def grams(hs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(hs) - GRAM, F.lit(0))),
            lambda i: F.struct(F.xxhash64(*[F.get(hs, i + j) for j in range(GRAM)]).alias("h"), i.alias("p")),
        )

    def least(gs: Column) -> Column:
        windows = F.sequence(F.lit(1), F.greatest(F.size(gs) + 1 - width, F.lit(1)))
        return F.transform(windows, lambda i: F.array_min(F.slice(gs, i, width)))

    def distinct(kept: Column) -> Column:
        # Equal fingerprints stand side by side; the first of each run stays.
        return F.filter(kept, lambda x, i: (i == 0) | (x.p != F.get(kept, i - 1).p))

    return let(hashes, lambda hs: F.when(F.size(hs) >= SPAN, let(let(grams(hs), least), distinct)))


def own_grams(hashes: Column, m: int) -> Column:
    """Every gram of ``m`` words, for items of just that length."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - m, F.lit(0))),
        lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + j) for j in range(m)]).alias("h"), F.lit(m).alias("n"), i.alias("p")),
    )


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast only after its bytes are summed; larger tables stay for a shuffled join."""
    total = df.agg(F.sum(size + 40)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _attempts(hs: Column, short: list[int]) -> Column:
    """Fingerprints and, for items of fewer words, all grams of their lengths: (h, n, p)."""
    tries = F.transform(F.coalesce(fingerprints(hs), F.array()), lambda f: F.struct(f.h.alias("h"), F.lit(SPAN).alias("n"), f.p.alias("p")))
    for m in short:
        tries = F.concat(tries, F.when(F.size(hs) >= m, own_grams(hs, m)).otherwise(F.array().cast(TRIES)))
    return tries


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, k1, k2 per row of ``docs(doc_id, text)``.

    k1 and k2 are the row's rows.keys(). An item of fewer than ``SPAN`` words is one window, found by its own
    length; an item without words, text or item_id is in nothing. A document without words has no hits. Repeated
    rows each give a row (a row is known by doc_id and text, either may be null); ties and repeated items change
    nothing, since hits are sets; empty tables give empty or clean results; other columns are ignored.

    Only fingerprints are joined first, thin rows; the texts come back for rows with a hit alone. The hits of one
    text are at most its words.
    """
    items = cut(benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("ws")).where("size(ws) > 0").distinct())
    short = sorted(r[0] for r in items.where(F.size("ws") < SPAN).select(F.size("ws")).distinct().collect())  # 9 at most
    n = F.least(F.size("ws"), F.lit(SPAN))
    windows = items.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.array_join(F.slice("ws", i + 1, n), " "))).alias("window")).distinct()
    windows = _small(cut(windows.groupBy("n", "window").agg(F.collect_set("item_id").alias("items"))), F.octet_length("window") + 8 * F.size("items"))

    own = items.select(F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    known = own.select(F.explode(F.filter(let(F.col("hs"), lambda hs: _attempts(hs, short)), lambda t: (t.n == SPAN) | (t.n == F.size("hs")))).alias("t"))
    known = _small(cut(known.select("t.h", "t.n").distinct()), F.lit(16))

    k1, k2 = keys()
    row = ["doc_id", "k1", "k2", "n_words"]
    hashed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    tried = hashed.select("doc_id", "k1", "k2", let(F.col("hs"), lambda hs: F.struct(F.size(hs).cast("bigint").alias("n_words"), _attempts(hs, short).alias("tries"))).alias("x"))
    # One row a document with position -1 beside the tries, so that one pass over the texts is enough.
    mark = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("n"), F.lit(-1).alias("p")))
    tries = tried.select("doc_id", "k1", "k2", F.col("x.n_words").alias("n_words"), F.explode(F.concat(mark, F.col("x.tries"))).alias("t")).select(*row, "t.*")
    hits = tries.join(known.withColumn("known", F.lit(True)), ["h", "n"], "left").where(F.col("known").isNotNull() | (F.col("p") < 0))
    hits = cut(hits.select(*row, "n", "p"))

    # Back for the texts with hits. Windows that hold a fingerprint begin at most SPAN - GRAM words before it.
    hit = cut(hits.where("p >= 0").groupBy("k1", "k2").agg(F.collect_set(F.struct("n", "p")).alias("at")))
    texts = sieve(docs.select("text", k1.alias("k1"), k2.alias("k2")), "k1", hit.select("k1"), "wanted").where("wanted").drop("wanted")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(hit, ["k1", "k2"])

    def starts(ws: Column, x: Column) -> Column:
        """Starts of the windows to test, with their lengths, as numbers, so that they are told apart by hash."""
        back = F.when(x.n == SPAN, F.lit(SPAN - GRAM)).otherwise(F.lit(0))
        return F.transform(F.sequence(F.greatest(x.p - back, F.lit(0)), F.least(x.p, F.size(ws) - x.n)), lambda i: i * 16 + x.n)

    def window(ws: Column, c: Column) -> Column:
        s, n = F.shiftright(c, 4), c % 16
        return F.struct(s.alias("s"), n.alias("n"), F.array_join(F.slice(ws, s + 1, n), " ").alias("window"))

    tested = let(words(F.col("text")), lambda ws: F.transform(F.array_distinct(F.flatten(F.transform("at", lambda x: starts(ws, x)))), lambda c: window(ws, c)))
    tested = texts.select("k1", "k2", F.explode(tested).alias("w")).select("k1", "k2", "w.*")
    found = tested.join(windows, ["n", "window"])
    grouped = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    # Words covered by the windows, in order of their starts.
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a.n + F.greatest(x.s + x.n - F.greatest(x.s, a.end), F.lit(0))).alias("n"), F.greatest(a.end, x.s + x.n).alias("end")),
        lambda a: a.n,
    )
    grouped = grouped.select("k1", "k2", covered.cast("bigint").alias("n_hit"), "item_ids")
    done = hits.where("p < 0").select(*row).join(grouped, ["k1", "k2"], "left")
    ids = F.coalesce("item_ids", F.array().cast(dict(grouped.dtypes)["item_ids"]))
    texts_of = F.array_sort(F.transform(ids, lambda x: x.cast("string")))
    return done.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(texts_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.array_sort(ids).alias("item_ids"),
        "k1",
        "k2",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all their columns, less the contaminated rows, each judged by its own text."""
    return without(docs, cut(contamination(docs, benchmark).where("contaminated").select("k1", "k2")))


#: Type of the tries of one document.
TRIES = "array<struct<h:bigint,n:int,p:int>>"
