"""State machines on streams: limits, expiry and jobs, a state a key with timers, that go on from a checkpoint.

Rows of a key are taken in order of ``ts`` within a batch; time is that of events, and the watermark alone ends what
no event ends. State lies in the state store of the stream, one entry a key (a list for limits), so a key's past is
bounded by its windows; the same processor gives the same rows whatever the cut of the stream into batches, as long
as batches come in order of time. ``run`` needs the RocksDB state store and sets it for its own query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(frame: pd.DataFrame) -> list[int]:
    return frame.ts.astype("datetime64[us]").astype("int64").tolist()


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch in order of time."""
    return pd.concat(list(rows)).sort_values(["ts", "event_id"])


class _Timed(StatefulProcessor):
    """A processor with one timer a key, at the millisecond when its state means nothing any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, micros: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


class RateLimiter(_Timed):
    """Requests let through while a user is under the limits of a minute and a day; only those let through count.

    Counts of one second are one entry. ``limits`` maps tiers to (a minute, a day); ``default`` serves other tiers.
    """

    OUTPUT = "user_id bigint, event_id bigint, allowed boolean, retry_after bigint, hit string"

    def __init__(self, limits: dict[str, tuple[int, int]], default: str):
        self.limits, self.default = limits, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.passed = handle.getListState("passed", "t bigint, n bigint")

    def decide(self, passed: list[tuple[int, int]], now: int, tier: str) -> tuple[bool, int | None, str | None]:
        """Whether a request at ``now`` passes; ``passed`` loses what left the day and gains what passes."""
        while passed and passed[0][0] <= now - 86_400 * MICROS:
            passed.pop(0)
        for name, seconds, most in zip(("minute", "day"), (60, 86_400), self.limits.get(tier, self.limits[self.default])):
            inside = [(t, n) for t, n in passed if t > now - seconds * MICROS]
            if sum(n for _, n in inside) >= most:
                oldest = inside[0][0] if inside else now
                return False, max(1, int(seconds - (now - oldest) / MICROS)), name
        if passed and now - passed[-1][0] < MICROS:
            passed[-1] = passed[-1][0], passed[-1][1] + 1
        else:
            passed.append((now, 1))
        return True, None, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, passed = _ordered(rows), [tuple(x) for x in self.passed.get()] if self.passed.exists() else []
        told = [self.decide(passed, now, tier) for now, tier in zip(_micros(frame), frame.tier)]
        self.passed.put(passed)
        if passed:
            self.wake(passed[-1][0] + 86_400 * MICROS)
        else:
            self.passed.clear()
        yield pd.DataFrame({"user_id": key[0], "event_id": frame.event_id.tolist(), "allowed": [x[0] for x in told], "retry_after": pd.array([x[1] for x in told], "Int64"), "hit": [x[2] for x in told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        return iter(())


class Expiry(_Timed):
    """One row whenever a key's last state outlives its ``ttl`` (seconds): when a later event shows it, or the watermark."""

    OUTPUT = "user_id bigint, state string, since timestamp, expired timestamp"

    def __init__(self, ttl: int):
        self.ttl = ttl * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "t bigint, state string")

    def rows(self, key, found: list[tuple[str, int]]) -> pd.DataFrame:
        at = lambda t: pd.to_datetime(t, unit="us")
        return pd.DataFrame({"user_id": key[0], "state": [s for s, _ in found], "since": [at(t) for _, t in found], "expired": [at(t + self.ttl) for _, t in found]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, found = self.last.get() if self.last.exists() else None, []
        frame = _ordered(rows)
        for now, state in zip(_micros(frame), frame.state):
            if last is not None and now > last[0] + self.ttl:
                found.append((last[1], last[0]))
            last = now, state
        self.last.update(tuple(last))
        self.wake(last[0] + self.ttl)
        if found:
            yield self.rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        self.last.clear()
        if last:
            yield self.rows(key, [(last[1], last[0])])


class JobStates(_Timed):
    """Jobs of a user: queued, running, done or error; what does not fit the state is refused.

    ``submit`` needs a job that is not active and fewer than ``most`` active ones, ``start`` a queued job, ``finish`` and
    ``fail`` a running one, ``poll`` one that is known; ``restart`` puts running jobs back in the queue. A job
    that ended is forgotten after ``retention`` seconds, one that did not is kept.
    """

    OUTPUT = "user_id bigint, event_id bigint, job bigint, action string, accepted boolean, state string"
    STEPS = {"start": ("queued", "running"), "finish": ("running", "done"), "fail": ("running", "error")}

    def __init__(self, most: int = 3, retention: int = 3600):
        self.most, self.retention = most, retention * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.jobs = handle.getMapState("jobs", "job bigint", "state string, ended bigint")

    def step(self, jobs: dict[int, tuple[str, int | None]], now: int, job: int, action: str) -> tuple[bool, str | None]:
        for j in [j for j, (_, ended) in jobs.items() if ended is not None and ended < now - self.retention]:
            del jobs[j]
        state = jobs.get(job, (None, None))[0]
        if action == "submit":
            fits = state not in ("queued", "running") and sum(s in ("queued", "running") for s, _ in jobs.values()) < self.most
            if fits:
                jobs[job] = "queued", None
        elif action == "restart":
            fits = True
            jobs.update({j: ("queued", None) for j, (s, _) in jobs.items() if s == "running"})
        elif action in self.STEPS:
            fits = state == self.STEPS[action][0]
            if fits:
                after = self.STEPS[action][1]
                jobs[job] = after, now if after in ("done", "error") else None
        else:
            fits = state is not None
        return fits, jobs.get(job, (None, None))[0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        jobs = {k[0]: (v[0], v[1]) for k, v in self.jobs.iterator()} if self.jobs.exists() else {}
        before, frame = dict(jobs), _ordered(rows)
        told = [self.step(jobs, now, job, action) for now, job, action in zip(_micros(frame), frame.job, frame.action)]
        for j in before.keys() - jobs.keys():
            self.jobs.removeKey((j,))
        for j, v in jobs.items():
            if before.get(j) != v:
                self.jobs.updateValue((j,), v)
        ends = [e for _, e in jobs.values() if e is not None]
        if ends:
            self.wake(min(ends) + self.retention)
        yield pd.DataFrame({"user_id": key[0], "event_id": frame.event_id.tolist(), "job": frame.job.tolist(), "action": frame.action.tolist(), "accepted": [x[0] for x in told], "state": [x[1] for x in told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = []
        for k, (_, ended) in list(self.jobs.iterator()):
            if ended is None:
                continue
            if ended + self.retention <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.jobs.removeKey(k)
            else:
                left.append(ended)
        if left:
            self.wake(min(left) + self.retention)
        return iter(())


def apply(stream: DataFrame, processor: StatefulProcessor, late: str = "0 seconds") -> DataFrame:
    """What ``processor`` says of ``stream(user_id, ts, event_id, ...)``; rows later than ``late`` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(processor, processor.OUTPUT, "Append", "EventTime")


def run(out: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all that is there and append the rows under ``path``; the next call goes on where this one ended."""
    spark, key = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
