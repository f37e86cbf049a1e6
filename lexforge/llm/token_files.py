"""Token-id files of patched frame-of-reference blocks.

A file is Parquet, one row a segment of consecutive documents in doc_id order. A segment's ids are
cut into blocks of ``BLOCK`` ids (documents may span blocks). Each block subtracts its minimum and
packs the differences at the width that costs least when the values beyond it (the chosen
percentile) go to an exception list of positions and high bits. ``block_starts`` indexes the byte
where each block begins, so any run of ids is read by unpacking only the blocks it touches.

Block layout, little-endian: minimum uint32, count uint16, width uint8, high width uint8,
exceptions uint16, packed low bits, exception positions uint16 each, packed high bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.tokens import encoder
from lexforge.session import importable

BLOCK = 1024
#: A segment is closed at so many ids; a longer document stays whole in its own.
SEGMENT_IDS = 1 << 17
#: Text bytes a range (and file) aims at.
RANGE_BYTES = 1 << 27
#: Values up to which packing goes bit by bit; most lists of exceptions are so short.
FEW = 512
HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("high", "u1"), ("out", "<u2")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values at ``width`` bits each, every row padded to whole bytes."""
    rows, n = values.shape
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view("u1").reshape(rows, -1)
    if rows * n <= FEW:
        bits = (values[:, :, None] >> np.arange(width, dtype="<u4")).astype("u1") & 1
        return np.packbits(bits.reshape(rows, -1), axis=1, bitorder="little")
    groups = -(-n // 8)  # eight values fill ``width`` bytes
    eight = np.zeros((rows, groups * 8), "<u8")
    eight[:, :n] = values
    eight = eight.reshape(rows, groups, 8)
    lanes = np.zeros((rows, groups, 4), "<u8")
    for j in range(8):
        lane, shift = divmod(j * width, 64)
        lanes[:, :, lane] |= eight[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            lanes[:, :, lane + 1] |= eight[:, :, j] >> np.uint64(64 - shift)
    return lanes.view("u1").reshape(rows, groups, 32)[:, :, :width].reshape(rows, groups * width)[:, : _size(n, width)]


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = packed.shape[0]
    if width == 0:
        return np.zeros((rows, n), "<u4")
    if width in (8, 16, 32):
        return np.ascontiguousarray(packed).view(f"<u{width // 8}").reshape(rows, n).astype("<u4")
    if rows * n <= FEW:
        bits = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(rows, n, width)
        return bits.astype("<u4") @ (np.uint32(1) << np.arange(width, dtype="<u4"))
    groups = -(-n // 8)
    padded = np.zeros((rows, groups * width), "u1")
    padded[:, : packed.shape[1]] = packed
    whole = np.zeros((rows, groups, 32), "u1")
    whole[:, :, :width] = padded.reshape(rows, groups, width)
    lanes, out = whole.view("<u8"), np.zeros((rows, groups, 8), "<u8")
    for j in range(8):
        lane, shift = divmod(j * width, 64)
        out[:, :, j] = lanes[:, :, lane] >> np.uint64(shift)
        if shift + width > 64:
            out[:, :, j] |= lanes[:, :, lane + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype("<u4").reshape(rows, groups * 8)[:, :n]


def _size(n: int, width: int) -> int:
    return (n * width + 7) // 8


def _choose(deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block (row): bits kept in place, and bits of its largest value."""
    n = deltas.shape[1]
    need = np.frexp(deltas.astype(np.float64))[1].clip(0)  # bit lengths
    top = need.max(axis=1)
    cell = need + 34 * np.arange(len(deltas))[:, None]
    count = np.bincount(cell.ravel(), minlength=34 * len(deltas)).reshape(-1, 34)
    beyond = n - np.cumsum(count, axis=1)  # values needing more than w bits
    w = np.arange(34)
    cost = n * w + beyond * (16 + np.maximum(top[:, None] - w, 0))
    cost[w[None, :] > top[:, None]] = 1 << 62
    return cost.argmin(axis=1), top


def _blocks(ids: np.ndarray) -> list[bytes]:
    """All blocks of one length, coded together."""
    low = ids.min(axis=1)
    deltas = ids - low[:, None]
    width, top = _choose(deltas)
    n, out = ids.shape[1], [b""] * len(ids)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(deltas[rows] & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(rows), 0), "u1")
        for r, p in zip(rows, packed):
            at = np.flatnonzero(deltas[r] >> np.uint32(w)) if top[r] > w else np.zeros(0, int)
            high = int(top[r] - w) if len(at) else 0
            head = np.array([(low[r], n, w, high, len(at))], HEAD).tobytes()
            rest = at.astype("<u2").tobytes() + _pack((deltas[r][at] >> np.uint32(w))[None, :], high).tobytes() if len(at) else b""
            out[r] = head + p.tobytes() + rest
    return out


def encode_ids(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """A payload of blocks and the byte where each begins."""
    ids = np.asarray(ids, "<u4")
    whole = len(ids) // BLOCK * BLOCK
    parts = _blocks(ids[:whole].reshape(-1, BLOCK)) if whole else []
    if whole < len(ids):
        parts += _blocks(ids[whole:][None, :])
    starts = np.cumsum([0, *map(len, parts)])[:-1].tolist() if parts else []
    return b"".join(parts), starts


def decode_ids(payload: bytes, starts: list[int], first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (exclusive)."""
    starts = list(starts)[first:last]
    heads = [np.frombuffer(payload, HEAD, 1, s)[0] for s in starts]
    alike: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        alike.setdefault((int(h["n"]), int(h["width"])), []).append(i)
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(starts)
    for (n, w), rows in alike.items():
        size = _size(n, w)
        packed = np.stack([np.frombuffer(payload, "u1", size, starts[i] + HEAD.itemsize) for i in rows])
        values = _unpack(packed, w, n)
        for i, v in zip(rows, values):
            h, at = heads[i], starts[i] + HEAD.itemsize + size
            if k := int(h["out"]):
                where = np.frombuffer(payload, "<u2", k, at)
                high = np.frombuffer(payload, "u1", _size(k, int(h["high"])), at + 2 * k)
                v[where] |= _unpack(high[None, :], int(h["high"]), k)[0] << np.uint32(w)
            out[i] = v + h["low"]
    return np.concatenate(out) if out else np.zeros(0, "<u4")


SEGMENT = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, block_starts array<bigint>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write token files in ascending doc_id order.

    Documents are dealt by ranges of doc_id, of some ``RANGE_BYTES`` of text, so that files in order of ``part`` hold
    ascending ids; a null text is empty and still gets its end id; null doc_ids come first; equal doc_ids stay side by
    side in order of their texts' hashes, and repeated rows are written each; a long text stays whole; an empty table
    gives files without rows. Other columns are ignored. No task holds more than one segment.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    n = partitions
    if n is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # Ranges may part rows of one doc_id by the hash of their texts, so an id that repeats without end fills no task.
    dealt = rows.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        held: list[tuple[int, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, segment
            payload, starts = encode_ids(np.frombuffer(b"".join(x for _, x in held), "<u4"))
            row = [part], [segment], [[d for d, _ in held]], [[len(x) // 4 for _, x in held]], [starts], [payload]
            held, size, segment = [], 0, segment + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        long = pa.list_(pa.int64())
        types, names = [pa.int32(), pa.int32(), long, long, long, pa.binary()], ["part", "segment", "doc_ids", "lengths", "block_starts", "payload"]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for d, b in zip(ids, coder.encode(batch.column("text"))):
                held.append((d, b + end))
                size += len(b) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield close()
        if held:
            yield close()

    dealt.mapInArrow(encode, SEGMENT).write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, part, segment, from the files.

    Starts come from a prefix sum over segment lengths alone, one small row a segment.
    """
    importable(spark)
    files = spark.read.parquet(path)
    totals = files.select("part", "segment", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    # One row a file reaches the driver; within a file a running sum over its segments, ids are not read.
    sums = totals.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ahead, run = [], 0
    for r in sums:
        ahead.append((r["part"], run))
        run += r["n"]
    parts = spark.createDataFrame(ahead, "part int, ahead bigint")
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    running = totals.select("part", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("within_file"))
    offsets = running.join(F.broadcast(parts), "part").select("part", "segment", (F.col("ahead") + F.col("within_file")).alias("begin"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_ids(r["payload"], r["block_starts"])
                n = np.array(r["lengths"], np.int64)
                to = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(to.tolist(), n.tolist())]
                cols = r["doc_ids"], to - n, n, crc, [r["part"]] * len(n), [r["segment"]] * len(n)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names)

    types, names = [pa.int64()] * 4 + [pa.int32()] * 2, ["doc_id", "within", "n_tokens", "ids_crc32", "part", "segment"]
    decoded = files.mapInArrow(decode, "doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint, part int, segment int")
    return decoded.join(offsets, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "segment")
