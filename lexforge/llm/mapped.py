"""Sorted arrays of 64-bit keys as files in the shared folder, memory-mapped by the workers that probe them.

Spark sorts the rows into ranges and each task writes its range as one Arrow file, so no row passes through the
driver; it learns the first key, the size and the name of each file. Workers map the files instead of loading them: a
node holds one copy in its page cache, whatever the number of its workers, and only the pages that searches touch.
Where the shared folder is no mounted folder (HDFS, S3) every executor gets the files by ``addFile`` and maps its copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import caches
from lexforge.session import importable, shared_dir

#: Rows a file; a task holds one range while it writes it.
RANGE_ROWS = 1 << 21

_OPEN: dict[str, pa.Table] = {}
caches.register("mapped", _OPEN.clear)


@dataclass(frozen=True)
class SortedArray:
    """What the driver knows: the first key of each file, ascending, and where the files are."""

    firsts: tuple[int, ...]
    files: tuple[str, ...]
    rows: int
    shipped: bool

    def _table(self, k: int) -> pa.Table:
        name = self.files[k]
        if name not in _OPEN:
            local = SparkFiles.get(name.rsplit("/", 1)[1]) if self.shipped else fs.FileSystem.from_uri(name)[1]
            with pa.memory_map(local) as source:
                _OPEN[name] = pa.ipc.open_file(source).read_all()
        return _OPEN[name]

    def probe(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table, np.ndarray, np.ndarray]]:
        """For each file that may hold some of ``keys``: which keys, its table, its keys, and where each belongs there
        (the leftmost place; beyond the end where all its keys are less)."""
        if not self.files or not len(keys):
            return
        at = np.searchsorted(np.array(self.firsts, np.int64), keys, side="right") - 1
        for k in np.unique(at[at >= 0]).tolist():
            which, table = np.flatnonzero(at == k), self._table(k)
            held = table.column("key").chunk(0).to_numpy()
            yield which, table, held, np.searchsorted(held, keys[which])


def write_sorted(rows: DataFrame, path: str, ship: bool | None = None) -> SortedArray:
    """Write ``rows`` (column ``key`` bigint without nulls, others as they are) sorted by key under ``path``.

    Equal keys stay in one file. A task that is run again writes another file; the one that counts names its own. An
    empty table gives no files. ``ship`` tells whether executors get copies (by default where the folder is not mounted).
    """
    spark = rows.sparkSession
    importable(spark)
    n = rows.count()
    ranges = max(1, -(-n // RANGE_ROWS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        name = f"{path}/{uuid.uuid4().hex}.arrow"
        store, at = fs.FileSystem.from_uri(name)
        with store.open_output_stream(at) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table, max_chunksize=len(table))
        yield pa.RecordBatch.from_arrays([pa.array([table.column("key")[0].as_py()]), pa.array([name])], ["first", "name"])

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    dealt = rows.repartitionByRange(ranges, "key").sortWithinPartitions(*(c for c in rows.columns if rows.schema[c].dataType.typeName() in ("long", "string", "integer")))
    index = sorted((r["first"], r["name"]) for r in dealt.mapInArrow(write, "first bigint, name string").collect())
    shipped = not isinstance(store, fs.LocalFileSystem) if ship is None else ship
    for _, name in index if shipped else []:
        spark.sparkContext.addFile(name)
    return SortedArray(tuple(f for f, _ in index), tuple(x for _, x in index), n, shipped)


def folder(spark, kind: str) -> str:
    """A new folder in the shared one, as a URI."""
    base = shared_dir(spark)
    return f"{base}/{kind}/{uuid.uuid4().hex}"


def best_of(counts: DataFrame, group: str, value: str, flag: str) -> DataFrame:
    """``counts`` with ``flag``, whether ``value`` is the greatest of its ``group``; few groups, so they are broadcast."""
    top = counts.groupBy(group).agg(F.max(value).alias("_top"))
    return counts.join(F.broadcast(top), group).withColumn(flag, F.col(value) == F.col("_top")).drop("_top")
