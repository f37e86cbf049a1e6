"""Event streams: windowed metrics, sliding limits, sessions, cooldowns, and per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, width: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count and sum of value by event type and time window, tumbling or sliding; a watermark makes it run on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_count(events: DataFrame, seconds: int) -> DataFrame:
    """Each event with the number of its user's events in the trailing window, itself included."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("t", t).withColumn("n_trailing", F.count(F.lit(1)).over(w)).drop("t")


def rate_limit(events: DataFrame, seconds: int, limits: dict[str, int], default: str = "free") -> DataFrame:
    """Each of ``events(user_id, ts, tier)`` with n, its user's events in the trailing window with itself, remaining of
    the tier's limit, and retry_after: seconds until the oldest of them leaves, where the limit is passed."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_t").rangeBetween(1 - seconds * 1_000_000, 0)
    counted = events.withColumn("_t", t).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_old", F.min("_t").over(w))
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in limits.items() for x in item]), F.col("tier")), F.lit(limits[default]))
    wait = (F.lit(seconds * 1_000_000) - (F.col("_t") - F.col("_old"))) / 1e6
    return counted.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("n"))).withColumn("retry_after", F.when(F.col("n") > limit, wait)).drop("_t", "_old")


def cache_hits(events: DataFrame, key: list[str], ttl: int) -> DataFrame:
    """Each event with whether the one before it of the same key is ``ttl`` seconds old at most."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(t).over(Window.partitionBy(*key).orderBy("ts", "event_id"))
    return events.withColumn("hit", F.coalesce(t - before <= ttl * 1_000_000, F.lit(False)))


def expired(events: DataFrame, key: str, state: str, ttl: int) -> DataFrame:
    """The last state of each key, and whether it is older than ``ttl`` seconds at the end of the log."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    last = events.groupBy(key).agg(F.max(t).alias("_t"), F.max_by(state, "ts").alias("state"))
    end = events.agg(F.max(t).alias("_end"))
    return last.join(F.broadcast(end), how="cross").withColumn("expired", F.col("_end") - F.col("_t") > ttl * 1_000_000).drop("_t", "_end")  # one row


def cooldown(events: DataFrame, seconds: float) -> DataFrame:
    """Each event with whether enough time passed since its user's event before."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return events.withColumn("allowed", F.coalesce(gap >= seconds, F.lit(True)))


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """user_id, session_no, start, n: a pause longer than the gap begins a new session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce((t - F.lag(t).over(w)) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    marked = events.withColumn("_f", fresh).withColumn("session_no", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session_no").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))


def running_totals(stream: DataFrame) -> DataFrame:
    """A stream of (user_id, n, total) after each batch, kept in per-user state."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def append_log(batch: DataFrame, path: str) -> None:
    """Append rows as JSON lines in a folder a day."""
    batch.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)
