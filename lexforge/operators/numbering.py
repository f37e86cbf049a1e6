"""Consecutive numbers over a sorted table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut


def number(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, its place (from 0) in the order of ``by``.

    Rows are dealt by ranges of the key and sorted within them; the sizes of the ranges, one number a partition, are
    summed on the driver. Nulls come first, ties in any order.
    """
    part, own = "_part", "_own"
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # Within a partition the generated ids count up from the partition's number shifted by 33 bits.
    rows = cut(dealt.withColumn(part, F.spark_partition_id()).withColumn(own, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ahead, total = [], 0
    for r in rows.groupBy(part).count().orderBy(part).collect():
        ahead.append((r[part], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(ahead, f"{part} int, _ahead bigint")
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(own) + F.col("_ahead")).drop(part, own, "_ahead")
