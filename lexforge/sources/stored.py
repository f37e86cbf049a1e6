"""Changes of stored tables: whole replacement, batches that are written once, and tables of buckets.

A plain table is a folder of Parquet parts; a change reads it and writes a new folder. A ``Sink`` takes numbered batches and
holds each once, whatever is replayed. A ``BucketTable`` deals rows by hashed key; a change rewrites the buckets it touches
and leaves the files of all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.session import cut


def replace(spark: SparkSession, df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write a table, partitioned by ``by``, and read it back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Sink:
    """Batches by number under ``path``: rows in ``data/batch=<id>``, and ``commits`` that tell which are whole.

    A batch is written, then committed; a batch that is committed is skipped, one that is not is written anew, so a run
    that dies anywhere and is repeated leaves every row once. Readers see committed batches only.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def open(spark: SparkSession, path: str) -> Sink:
        """The sink at ``path``, made if it is not there."""
        spark.createDataFrame([], "id bigint").write.mode("ignore").parquet(f"{path}/commits/none")
        return Sink(spark, path)

    def committed(self) -> DataFrame:
        return self.spark.read.schema("id bigint").option("recursiveFileLookup", True).parquet(f"{self.path}/commits")

    def write(self, batch: DataFrame, batch_id: int) -> bool:
        """Whether the batch was written now."""
        if not self.committed().where(F.col("id") == batch_id).isEmpty():
            return False
        batch.write.mode("overwrite").parquet(f"{self.path}/data/batch={batch_id}")
        self.spark.createDataFrame([(batch_id,)], "id bigint").write.mode("overwrite").parquet(f"{self.path}/commits/{batch_id}")
        return True

    def read(self, schema) -> DataFrame:
        """Rows of all committed batches."""
        paths = [f"{self.path}/data/batch={r['id']}" for r in self.committed().orderBy("id").collect()]  # a number a batch
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def dual_write(batch: DataFrame, batch_id: int, first: Sink, second: Sink) -> None:
    """Write one batch to both sinks; as a foreachBatch step it may be repeated and both still agree.

    The batch is computed once, so both get the same rows, and each sink keeps account of its own.
    """
    rows = cut(batch)
    first.write(rows, batch_id)
    second.write(rows, batch_id)


def stream_to(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take in all that is there, a batch at a time, and go on at the first batch not done when called again."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@dataclass(frozen=True)
class BucketTable:
    """A table of ``buckets`` by hashed ``key`` under ``path``; the newest manifest names the folder of each bucket.

    Changes write new folders of the buckets they touch, then a manifest; a reader holds on to its own manifest, and
    a change that dies before its manifest has changed nothing.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def create(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> BucketTable:
        """A new table; of rows with one key it holds any one, so give it distinct ones or upsert them."""
        table = BucketTable(rows.sparkSession, path, tuple(key), buckets)
        table._write(rows, 0, {})
        return table

    def manifest(self) -> tuple[int, dict[int, int]]:
        """The newest version, and the version at which each bucket was last written: a number a bucket."""
        rows = self.spark.read.schema("version int, bucket int, written int").option("recursiveFileLookup", True).parquet(f"{self.path}/manifests")
        newest = rows.groupBy().agg(F.max("version")).first()[0]
        return newest, {r["bucket"]: r["written"] for r in rows.where((F.col("version") == newest) & (F.col("bucket") >= 0)).collect()}

    def _write(self, rows: DataFrame, version: int, before: dict[int, int], touched: set[int] | None = None) -> None:
        placed = rows.withColumn("_bucket", self.bucket())
        placed.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/data/version={version}")
        if touched is None:
            touched = set(range(self.buckets))
        # Buckets that lost their last row have no folder.
        held = {r[0] for r in self.spark.read.schema("_bucket int").parquet(f"{self.path}/data/version={version}").distinct().collect()} if touched else set()
        now = {b: v for b, v in before.items() if b not in touched} | {b: version for b in held}
        rows = [(version, b, v) for b, v in now.items()] or [(version, -1, -1)]
        self.spark.createDataFrame(rows, "version int, bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")

    def _folders(self, written: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/version={v}/_bucket={b}" for b, v in sorted(written.items())]

    def read(self, schema) -> DataFrame:
        paths = self._folders(self.manifest()[1])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _change(self, touched: set[int], schema, after: Callable[[DataFrame], DataFrame]) -> set[int]:
        version, written = self.manifest()
        paths = self._folders({b: v for b, v in written.items() if b in touched})
        old = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        self._write(after(old), version + 1, written, touched)
        return touched

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def upsert(self, rows: DataFrame, order: str) -> set[int]:
        """Take ``rows`` in: of rows with one key, stored or new, that of the greatest ``order`` stays. Returns the
        buckets that were rewritten; null keys have a bucket like others."""
        rows = cut(rows)
        key = [F.col(c) for c in self.key]
        rest = [c for c in rows.columns if c not in self.key]
        best = lambda d: d.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*").select(*rows.columns)
        return self._change(self._touched(rows), rows.schema, lambda old: best(old.select(*rows.columns).unionByName(rows)))

    def delete(self, keys: DataFrame, schema) -> set[int]:
        """Drop the rows of ``keys``; returns the buckets that were rewritten."""
        keys = cut(keys.select(*self.key).distinct())
        return self._change(self._touched(keys), schema, lambda old: old.join(keys, list(self.key), "left_anti"))


def without_rows(table: DataFrame, ids: DataFrame, key: str, namespace: str | None = None, whole: tuple = ()) -> DataFrame:
    """``table`` less the rows of ``ids``, and less whole namespaces; a namespace that is null stays."""
    left = table.join(ids.select(key).distinct(), key, "left_anti").select(*table.columns)
    return left if namespace is None or not whole else left.where(~F.coalesce(F.col(namespace).isin(*whole), F.lit(False)))


def insert_if_absent(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``table`` and the incoming rows whose key it has not."""
    return table.unionByName(incoming.join(table.select(key), key, "left_anti").select(*table.columns))
