"""Packing by shortest-pack-first over the histogram of piece lengths.

Documents are encoded, cut into pieces of at most ``max_len`` ids (all full but the last), and only
the histogram of lengths (``max_len`` numbers) reaches the driver. There lengths are placed longest
first, each into the packs with the most room left, updating counts of packing patterns; a pattern
list has a bounded size whatever the corpus. Pieces then find their pattern by rank within length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.tokens import encoder
from lexforge.session import cut, importable

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, local_rank bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row a piece of ``docs(doc_id, text)``; ``with_ids`` adds the ids themselves (binary uint32).

    A null or empty text is one piece of its end id; a long text gives many pieces; repeated rows and null
    doc_ids give theirs each; an empty table gives none; other columns, whatever their names, are ignored.
    ``local_rank`` counts pieces of the same length within its partition ``part``; both hold for one
    evaluation, so cut() the result before ranking.
    """
    importable(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for d, b in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                b += end
                for at in range(0, len(b), 4 * max_len):
                    p = b[at : at + 4 * max_len]
                    n = len(p) // 4
                    rows.append((d, at // 4, n, zlib.crc32(p), len(b) // 4, part, seen[n], *([p] if with_ids else [])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE + ", ids binary" * with_ids)


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: times}) packs covering the histogram, shortest pack first.

    Each length splits at most one group of packs, so there are at most two groups a length.
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max_len
        while left and room >= length:
            # Packs with the most room are the shortest ones.
            for group in by_room.pop(room, []) if room < max_len else []:
                count, made = group
                if not left:
                    by_room[room].append(group)
                    continue
                times = min(room // length, -(-left // count))
                full, rest = (count, 0) if left >= count * times else divmod(left, times)
                if full < count and full == 0:
                    times, full, rest = left, 1, 0
                by_room[room - times * length].append([full, {**made, length: made.get(length, 0) + times}])
                left -= full * times
                if count - full:
                    by_room[room].append([count - full, made])
                    if left:
                        # A last pack takes what is left over of a full helping.
                        last = min(left, room // length)
                        by_room[room].pop()
                        by_room[room - last * length].append([1, {**made, length: made.get(length, 0) + last}])
                        left -= last
                        if count - full - 1:
                            by_room[room].append([count - full - 1, made])
            room = max((r for r in by_room if length <= r < room), default=0)
        if left:
            times = max_len // length
            if left >= times:
                by_room[max_len - times * length].append([left // times, {length: times}])
            if left % times:
                by_room[max_len - left % times * length].append([1, {length: left % times}])
    return [(c, made) for groups in by_room.values() for c, made in groups]


def allotments(packs: list[tuple[int, dict[int, int]]], max_len: int) -> np.ndarray:
    """Columns: length, first rank, times a pack, first sequence, first offset; sorted by length and rank."""
    rows, sequence, rank = [], 0, defaultdict(int)
    for count, made in sorted(packs, key=lambda p: sorted(p[1].items(), reverse=True), reverse=True):
        offset = 0
        for length in sorted(made, reverse=True):
            rows.append((length, rank[length], made[length], sequence, offset))
            rank[length] += count * made[length]
            offset += length * made[length]
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Give every piece its sequence_id and offset. ``pieces`` as of cut_pieces, already cut().

    Pieces of one length are alike: which of them takes which place is told by ``part`` and ``local_rank``. Columns
    named ahead, sequence_id or offset are not carried. No pieces give no sequences.
    """
    spark = pieces.sparkSession
    importable(spark)
    pieces = pieces.drop("ahead", "sequence_id", "offset")
    cells = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(allotments(patterns(histogram, max_len), max_len))  # bounded by max_len

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        keys = (table[:, 0] << 46) | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("ahead").to_numpy()
            row = table[np.searchsorted(keys, (length << 46) | rank, side="right") - 1]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            keep = [n for n in batch.schema.names if n not in ("part", "local_rank", "ahead")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)], [*keep, "sequence_id", "offset"])

    kept = ", ".join(f"{n} {t}" for n, t in pieces.dtypes if n not in ("part", "local_rank"))
    return pieces.join(cells.drop("n"), ["length", "part"]).select(*pieces.columns, "ahead").mapInArrow(place, kept + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, max_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training sequences: sequence_id, ids (padded unless a power of two long), n_tokens, doc_ids, lengths.

    ``packed`` has ids (cut_pieces with_ids). A sequence holds at most ``max_len`` ids, so groups are small.
    """
    importable(packed.sparkSession)
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    joined = grouped.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("raw"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
    n = (F.octet_length("raw") / 4).cast("int")
    pad = F.when(F.pow(F.lit(2), F.round(F.log2(n))) == n, F.lit(0)).otherwise(F.lit(max_len) - n)
    filler = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({max_len} as int))"))
    return joined.select("sequence_id", F.concat("raw", F.substring(filler, F.lit(1), pad.cast("int") * 4)).alias("ids"), n.alias("n_tokens"), "doc_ids", "lengths")
