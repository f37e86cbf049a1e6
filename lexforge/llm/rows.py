"""Rows known by what they hold, and a sieve that spares shuffles.

A row is known by two 64-bit hashes of doc_id and text, so nulls and ids that repeat with another text
are told apart. The sieve is a bitmap of hashed keys of at most ``MOST_BITS`` bits, whatever the input; it lets
through every wanted row and some others, which a join then removes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of the bitmap (fixed by Spark's bitmap functions), and of the whole: 16 MB are broadcast at most.
ROW_BITS, LEAST_BITS, MOST_BITS = 1 << 15, 1 << 20, 1 << 27


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that know a row; a null differs from every value."""
    has = F.concat_ws("", F.col(doc_id).isNull().cast("string"), F.col(text).isNull().cast("string"))
    return F.xxhash64(F.col(doc_id), F.col(text), has), F.xxhash64(has, F.col(text), F.col(doc_id))


def sieve(df: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``, true for every row whose ``key`` (a hash, bigint) is in ``wanted`` and for
    few others. ``wanted`` has a column ``key`` and should be materialised."""
    n = wanted.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(n, 1)))))
    row = lambda c: F.shiftright(F.pmod(c, F.lit(bits)), 15).cast("int")
    place = lambda c: F.pmod(c, F.lit(ROW_BITS))
    number, bitmap = fresh(df, "_row", "_bitmap")
    bits_of = wanted.groupBy(row(F.col(key)).alias(number)).agg(F.bitmap_construct_agg(place(F.col(key))).alias(bitmap))
    at = place(F.col(key))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))
    known = F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False))
    joined = df.withColumn(number, row(F.col(key))).join(F.broadcast(bits_of), number, "left")
    return joined.withColumn(flag, known).drop(number, bitmap)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose keys() are in ``gone(k1, k2)``; only rows that the sieve suspects are shuffled."""
    k1, k2, flag = fresh(docs, "_k1", "_k2", "_suspect")
    gone = gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    a, b = keys()
    marked = sieve(docs.withColumn(k1, a).withColumn(k2, b), k1, gone, flag)
    stay = marked.where(~F.col(flag))
    rest = marked.where(F.col(flag)).join(gone, [k1, k2], "left_anti")
    return stay.unionByName(rest).select(*docs.columns)
