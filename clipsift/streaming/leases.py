"""Job leases with expiry and sessions with a time to live, as keyed state with timers; and the same as folds of a whole log."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Seconds of a lease, tries of a job; a worker beats every third of a lease.
LEASE_SECONDS, ATTEMPTS = 120, 3
#: Seconds of a session.
SESSION_SECONDS = 7 * 24 * 3600
MICRO = 1_000_000
STATE = "status string, attempts int, until long, n long"
CHANGES = StructType([StructField("job", LongType()), StructField("n", LongType()), StructField("at", LongType()), StructField("status", StringType()), StructField("attempts", IntegerType())])
Lease = tuple[str, int, int | None]


def step(state: Lease, event: str, at: int, lease: int, attempts: int) -> Lease:
    """The state after an event at ``at`` (microseconds). ``state`` is (status, attempts, end of the lease) and hasn't lapsed by then.

    enqueue resets a job; claim of a queued one is an attempt and starts a lease; heartbeat renews a running one's; complete ends
    it; fail gives it back, or ends it after the last attempt. Other events, also those that come too late, change nothing.
    """
    status, n, until = state
    if event == "enqueue":
        return "queued", 0, None
    if event == "claim" and status == "queued":
        return "running", n + 1, at + lease
    if status == "running":
        if event == "heartbeat":
            return status, n, at + lease
        if event == "complete":
            return "complete", n, None
        if event == "fail":
            return lapsed(state, attempts)
    return state


def lapsed(state: Lease, attempts: int) -> Lease:
    """The state once a lease has ended without completion: queued again, or failed after the last attempt."""
    return ("failed" if state[1] >= attempts else "queued"), state[1], None


def passed(state: Lease, event: str, at: int, lease: int, attempts: int) -> list[tuple[int, Lease]]:
    """(time, state) of each change that an event makes, a lease that ended before it first."""
    out = []
    if state[2] is not None and state[2] <= at:
        out.append((state[2], lapsed(state, attempts)))
        state = out[0][1]
    after = step(state, event, at, lease, attempts)
    if after != state:
        out.append((at, after))
    return out


class Leases(StatefulProcessor):
    """State of each job; a timer at a lease's end gives back what its worker lost without another event having to come."""

    def __init__(self, lease_seconds: int = LEASE_SECONDS, attempts: int = ATTEMPTS):
        self.lease, self.attempts = lease_seconds * MICRO, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lease", STATE)

    def _get(self) -> tuple[Lease, int]:
        if not self.held.exists():
            return ("new", 0, None), 0
        status, attempts, until, n = self.held.get()
        return (status, attempts, until), n

    def _take(self, job: int, old: Lease, changes: list[tuple[int, Lease]], n: int) -> Iterator[Row]:
        for at, state in changes:
            n += 1
            yield Row(job=job, n=n, at=at, status=state[0], attempts=state[1])
        if changes:
            last = changes[-1][1]
            self.held.update((*last, n))
            if old[2] is not None and old[2] != last[2]:
                self.handle.deleteTimer(-(-old[2] // 1000))
            if last[2] is not None and last[2] != old[2]:
                self.handle.registerTimer(-(-last[2] // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, n = self._get()
        state, changes = start, []
        for at, _, event in sorted((r["at"], r["seq"], r["event"]) for r in rows):
            for change in passed(state, event, at, self.lease, self.attempts):
                changes.append(change)
                state = change[1]
        yield from self._take(key[0], start, changes, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, n = self._get()
        if state[2] is not None and -(-state[2] // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            after = lapsed(state, self.attempts)
            yield Row(job=key[0], n=n + 1, at=state[2], status=after[0], attempts=after[1])
            self.held.update((*after, n + 1))

    def close(self) -> None:
        pass


def lease_changes(events: DataFrame, lease_seconds: int = LEASE_SECONDS, attempts: int = ATTEMPTS, delay: str = "0 seconds") -> DataFrame:
    """(job, n, at, status, attempts) of each change of a stream of (job, seq, ts, event); the n-th of a job, at in microseconds.

    Events of one batch are taken in order of time; a lease ends when the watermark passes its end, and at its end. The session
    needs the RocksDB state store.
    """
    timed = events.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("job").transformWithState(statefulProcessor=Leases(lease_seconds, attempts), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def lease_states(changes: DataFrame) -> DataFrame:
    """(job, status, attempts): the last change of each job."""
    return changes.groupBy("job").agg(F.max_by(F.struct("status", "attempts"), "n").alias("s")).select("job", "s.status", "s.attempts")


def replay_leases(log: DataFrame, now: datetime, lease_seconds: int = LEASE_SECONDS, attempts: int = ATTEMPTS) -> DataFrame:
    """(job, status, attempts) after a whole log of (job, seq, ts, event), as of ``now``; a job's events stream past in order, none is gathered."""
    import pyarrow as pa

    lease, end = lease_seconds * MICRO, int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp() * MICRO)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = None, ("new", 0, None)

        def closed() -> tuple:
            return (job, *(lapsed(state, attempts) if state[2] is not None and state[2] <= end else state)[:2])

        for batch in batches:
            out = []
            for j, at, _, event in zip(*(c.to_pylist() for c in batch.columns)):
                if j != job:
                    if job is not None:
                        out.append(closed())
                    job, state = j, ("new", 0, None)
                for _, state in passed(state, event, at, lease, attempts):
                    pass
            yield pa.RecordBatch.from_pylist([dict(zip(("job", "status", "attempts"), r)) for r in out], schema)
        if job is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("job", "status", "attempts"), closed()))], schema)

    schema = pa.schema([("job", pa.int64()), ("status", pa.string()), ("attempts", pa.int32())])
    rows = log.where("job is not null").select(F.col("job").cast("long"), F.unix_micros("ts").alias("at"), "seq", "event")
    return rows.repartition("job").sortWithinPartitions("job", "at", "seq").mapInArrow(run, "job long, status string, attempts int")


# --- sessions


LIVE = StructType([StructField("token", LongType()), StructField("account", LongType()), StructField("at", LongType()), StructField("change", StringType())])


class Sessions(StatefulProcessor):
    """Live sessions of an account: a map of tokens to their ends, from which those that ended go with every write and by timers.

    A call of the state store takes longer than an event, so the map is read once for all events of a batch, and only what they
    changed in the end is written. An account has one timer, at its earliest end.
    """

    def __init__(self, seconds: int = SESSION_SECONDS):
        self.span = seconds * MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "token long", "until long")

    def _read(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.ends.iterator()} if self.ends.exists() else {}

    def _write(self, old: dict[int, int], ends: dict[int, int], fired: bool = False) -> None:
        for token in old.keys() - ends.keys():
            self.ends.removeKey((token,))
        for token, until in ends.items():
            if old.get(token) != until:
                self.ends.updateValue((token,), (until,))
        was, due = (-(-min(x.values()) // 1000) if x else None for x in (old, ends))
        if was != due and was is not None and not fired:
            self.handle.deleteTimer(was)
        if was != due and due is not None:
            self.handle.registerTimer(due)

    @staticmethod
    def _purge(account: int, ends: dict[int, int], queue: list[tuple[int, int]], at: int) -> Iterator[Row]:
        """Sessions that ended by ``at`` leave ``ends``; ``queue`` is a heap of (end, token), also of sessions that were closed or renewed since."""
        while queue and queue[0][0] <= at:
            until, token = heapq.heappop(queue)
            if ends.get(token) == until:
                del ends[token]
                yield Row(token=token, account=account, at=until, change="expired")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self._read()
        ends, queue = dict(old), sorted((until, token) for token, until in old.items())
        for at, token, event in sorted((r["at"], r["token"], r["event"]) for r in rows):
            yield from self._purge(key[0], ends, queue, at)
            if event == "login":
                ends[token] = at + self.span
                heapq.heappush(queue, (at + self.span, token))
                yield Row(token=token, account=key[0], at=at, change="opened")
            elif event == "logout" and ends.pop(token, None) is not None:
                yield Row(token=token, account=key[0], at=at, change="closed")
        self._write(old, ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self._read()
        ends, queue = dict(old), sorted((until, token) for token, until in old.items())
        yield from self._purge(key[0], ends, queue, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000)
        self._write(old, ends, fired=True)

    def close(self) -> None:
        pass


def session_changes(events: DataFrame, seconds: int = SESSION_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(token, account, at, change: opened, closed or expired) of a stream of (account, token, ts, event: login or logout); other events only let time pass."""
    timed = events.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    timed = timed.where(F.col("event").isin("login", "logout") | F.col("ts").isNull())  # as it names the time, Spark leaves it above the watermark, which every event moves
    return timed.groupBy("account").transformWithState(statefulProcessor=Sessions(seconds), outputStructType=LIVE, outputMode="Append", timeMode="EventTime")


def replay_sessions(log: DataFrame, now: datetime, seconds: int = SESSION_SECONDS) -> DataFrame:
    """(account, token, until): sessions that are live as of ``now`` after a whole log; the last login of a token counts, if no logout followed."""
    last = Window.partitionBy("account", "token").orderBy(F.desc("ts"), F.desc("event"))  # of equal times a logout comes last
    kept = log.where("event in ('login', 'logout')").withColumn("_n", F.row_number().over(last)).where("_n = 1 and event = 'login'")
    until = F.unix_micros("ts") + seconds * MICRO
    end = int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp() * MICRO)
    return kept.select("account", "token", until.alias("until")).where(F.col("until") > end)
