"""Shards of near-equal bytes by minimax contiguous partition of ordered atomic groups.

An atomic group is all rows of one text; groups are ordered by the hash of the text. Their sizes do not reach the
driver one by one: a histogram of hash ranges does, and gives two capacities, one that whole ranges can keep and
one that no partition can beat. Ranges in which a cut may fall are split finer until both agree: that is
the smallest capacity of the groups themselves. There the greedy pass cuts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import cut

#: Bits of the first histogram, those that a range gains when it is split, and ranges split in one pass.
FIRST_BITS, MORE_BITS, SPLIT = 15, 6, 512
#: Rows numbered by one task at most, about.
CELL_ROWS = 2_000


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the shard of each group in order.

    Any cut whose shards all fit the capacity is optimal; each shard stops at the group nearest to
    an even share of what is left, so that the last ones are not short.
    """
    before = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    total, n = int(before[-1]), len(sizes)

    def feasible(cap: int) -> bool:
        at = 0
        for _ in range(shards):
            at = int(np.searchsorted(before, before[at] + cap, side="right")) - 1
            if at >= n:
                return True
        return False

    low, high = max([0, -(-total // shards), *sizes]), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    # From the back: the earliest group each shard may begin at, so that those after it fit.
    latest = [n] * (shards + 1)
    for k in range(shards - 1, -1, -1):
        latest[k] = int(np.searchsorted(before, before[latest[k + 1]] - low, side="left"))
    at, out = 0, []
    for k in range(shards):
        share = before[at] + (total - before[at]) / (shards - k)
        end = int(np.searchsorted(before, share, side="left"))
        if 0 < end <= n and end - 1 >= at and share - before[end - 1] < before[min(end, n)] - share:
            end -= 1
        most = int(np.searchsorted(before, before[at] + low, side="right")) - 1
        end = n if k == shards - 1 else min(max(end, latest[k + 1], at), most, n)
        out += [k] * (end - at)
        at = end
    return low, out


class Ranges:
    """Ranges of hashes in order: (first hash, bits, bytes, single), all but single ones hold several groups."""

    def __init__(self, items: list[tuple[int, int, int, bool]], shards: int):
        self.items, self.shards = sorted(items), shards
        self.before = np.concatenate([[0], np.cumsum(np.array([r[2] for r in self.items], np.int64))])
        self.single = np.array([r[3] for r in self.items], bool)
        self.total = int(self.before[-1])

    def steps(self, cap: int, loose: bool) -> list[int]:
        """Where a greedy pass of capacity ``cap`` cuts, in bytes; loosely also within ranges of several groups."""
        at, out = 0, []
        for _ in range(self.shards):
            end = at + cap
            if end >= self.total:
                at = self.total
            else:
                i = int(np.searchsorted(self.before, end, side="right")) - 1
                at = end if loose and not self.single[i] else max(at, int(self.before[i]))
            out.append(at)
        return out

    def least_loose(self, high: int) -> int:
        """The smallest capacity if ranges of several groups could be cut anywhere; no partition of groups beats it."""
        low = max([0, -(-self.total // self.shards), *(r[2] for r in self.items if r[3])])
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.steps(mid, True)[-1] >= self.total else (mid + 1, high)
        return low

    def undecided(self, low: int, high: int) -> list[tuple[int, int, int, bool]]:
        """Ranges of several groups in which a cut may fall for some capacity between the two; the largest of them."""
        found = set()
        for a, b in zip(self.steps(low, False), self.steps(high, True)):
            i, j = int(np.searchsorted(self.before, a, side="right")) - 1, int(np.searchsorted(self.before, b, side="left"))
            found.update(k for k in range(i, min(j + 1, len(self.items))) if not self.single[k])
        return sorted((self.items[k] for k in found), key=lambda r: (-r[2], r[0]))[:SPLIT]


def _histogram(rows: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
    """Ranges of ``bits`` bits of the hash ``h``, from the rows given."""
    start = F.shiftrightunsigned("h", 64 - bits)
    found = rows.groupBy(start.alias("start")).agg(F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("single")).collect()
    return [((r["start"] % (1 << bits)) << (64 - bits), bits, r["size"], r["single"]) for r in found]


def capacity(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity over groups of equal ``h`` of ``rows(h, size)``, and the first hash (unsigned) of each
    shard but the first. At most a few times 2 ** FIRST_BITS ranges are held."""
    held = Ranges(_histogram(rows, FIRST_BITS), shards)
    while True:
        high, placed = minimax([r[2] for r in held.items], shards)
        split = held.undecided(held.least_loose(high), high) if held.least_loose(high) < high else []
        if not split:
            break
        new, spark = [], rows.sparkSession
        for bits in sorted({r[1] for r in split}):
            # SPLIT prefixes at most
            some = spark.createDataFrame([((r[0] >> (64 - bits)),) for r in split if r[1] == bits], "start bigint")
            within = rows.withColumn("start", F.shiftrightunsigned("h", 64 - bits)).join(F.broadcast(some), "start", "left_semi")
            new += _histogram(within, min(64, bits + MORE_BITS))
        held = Ranges([r for r in held.items if r not in set(split)] + new, shards)
    starts = [next((r[0] for r, p in zip(held.items, placed) if p >= k), 1 << 64) for k in range(1, shards)]
    return high, starts


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs(doc_id, text)``.

    size is the UTF-8 bytes of the text (null: none) plus 8. Equal texts share a shard; a null text is as an empty
    one, its crc32 too. Slots number each shard's rows without gaps; which row of a shard takes which is not
    promised. Repeated rows each get a slot, null doc_ids too; a text longer than a shard's share makes that
    shard large, and no partition could help it; an empty table gives no rows; other columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(docs.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), F.monotonically_increasing_id().alias("row")))
    _, starts = capacity(rows, shards)
    # Unsigned order of hashes is signed order with the first bit turned.
    turned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    passed = [(turned >= F.lit(s - (1 << 63))).cast("int") if s < 1 << 64 else F.lit(0) for s in starts]
    dealt = rows.withColumn("shard", sum(passed, F.lit(0)))
    cells = {r["shard"]: max(1, -(-r["count"] // CELL_ROWS)) for r in dealt.groupBy("shard").count().collect()}  # one number a shard
    of = F.element_at(F.array(*[F.lit(cells.get(k, 1)) for k in range(shards)]), F.col("shard") + 1)
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("row"), of))
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("at", F.row_number().over(own)).join(before, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
