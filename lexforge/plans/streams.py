"""Registered queries on streams: events arrive in slices of time, each query stops half way and goes on from its checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge.session import shared_dir, table
from lexforge.streaming import stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class _Arrivals:
    """events as a folder that grows: ``more`` writes the next slices of time, ``stream`` reads a file a batch."""

    def __init__(self, spark: SparkSession, sf_dir: str, slices: int = 4):
        self.spark, self.events = spark, table(spark, sf_dir, "events").where("ts is not null and user_id is not null")
        self.base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
        low, high = self.events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
        self.low, self.step, self.slices = low or 0, ((high or 0) - (low or 0)) // slices + 1, slices
        self.events.limit(0).write.parquet(f"{self.base}/in")

    def more(self, which: range) -> None:
        at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - self.low) / self.step)
        for k in which:
            self.events.where(at == k).write.mode("append").parquet(f"{self.base}/in")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.events.schema).option("maxFilesPerTrigger", 1000).parquet(f"{self.base}/in")

    def through(self, processor, columns: dict) -> DataFrame:
        """What a processor says, with a restart in the middle."""
        for half in (range(self.slices // 2), range(self.slices // 2, self.slices)):
            self.more(half)
            rows = self.stream().withColumns(columns)
            stateful.run(stateful.apply(rows, processor), f"{self.base}/out", f"{self.base}/checkpoint")
        return self.spark.read.schema(processor.OUTPUT).parquet(f"{self.base}/out")


TTL = 86_400


@query(f"""with e as (select user_id, event_type state, ts since, lead(ts) over (partition by user_id order by ts, event_id) later, max(ts) over () last from events where ts is not null and user_id is not null)
select user_id, state, strftime(since, '%Y-%m-%d %H:%M:%S') since, strftime(since + interval {TTL} second, '%Y-%m-%d %H:%M:%S') expired from e where later > since + interval {TTL} second or (later is null and since + interval {TTL} second <= last)""")
def st_ttl_expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state of a user that nothing renewed for a day, told by a later event or by the watermark's timer."""
    told = _Arrivals(spark, sf_dir).through(stateful.Expiry(TTL), {"state": F.col("event_type")})
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return told.select("user_id", "state", text("since"), text("expired"))


#: Tiers of users for the test of limits, low enough that some requests are refused.
LIMITS = {"free": (1, 2), "pro": (2, 3)}


def tier() -> F.Column:
    return F.when(F.col("user_id") % 3 == 0, "pro").when(F.col("user_id") % 3 == 1, "other").otherwise("free")


def job_columns() -> dict:
    """A job number and an action out of an event."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "submit").when(kind == "view", "start").when(kind == "purchase", "finish").when(kind == "error", "fail").otherwise("poll")
    return {"job": F.col("event_id") % 4, "action": action}


@query()
def st_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event let through or refused by its user's limits of a minute and a day; a test runs it in plain Python."""
    return _Arrivals(spark, sf_dir).through(stateful.RateLimiter(LIMITS, "free"), {"tier": tier()})


@query()
def st_job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action on a user's jobs, accepted or refused by the job's state; a test runs it in plain Python."""
    return _Arrivals(spark, sf_dir).through(stateful.JobStates(), job_columns())


class Killed(RuntimeError):
    """Raised in place of a lost driver."""


@query("select 'first' store, count(*) n, count(distinct event_id) ids from events where ts is not null and user_id is not null union all select 'second', count(*), count(distinct event_id) from events where ts is not null and user_id is not null")
def st_checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into two sinks that dies between the writes of a batch and is started again: every row is in both once."""
    arrivals = _Arrivals(spark, sf_dir)
    first, second = (S.Sink.open(spark, f"{arrivals.base}/{n}") for n in ("first", "second"))
    checkpoint, deaths = f"{arrivals.base}/dual", [1]

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id in deaths:
            deaths.remove(batch_id)
            first.write(batch, batch_id)
            raise Killed(f"between the writes of batch {batch_id}")
        S.dual_write(batch, batch_id, first, second)

    for half in (range(2), range(2, 4)):
        arrivals.more(half)
        for _ in range(2):
            try:
                S.stream_to(arrivals.stream(), step, checkpoint)
                break
            except Exception as e:  # the stream reports what its step raised
                if "between the writes" not in str(e):
                    raise
    schema = arrivals.events.schema
    both = [s.read(schema).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")).withColumn("store", F.lit(n)) for n, s in (("first", first), ("second", second))]
    return both[0].unionByName(both[1])
