"""A job queue as one stateful stream: claims, leases that expire, and retries after a backoff, each at its own time.

State holds the open jobs of a queue; a job that is done or failed for good leaves it. What happens by itself (a lease that
expires, a retry whose wait is over) happens at the time it is due: before a later row of the queue is applied, or by an
event-time timer if no row comes. So the transitions don't depend on how rows are cut into micro-batches, nor on where a
stream was stopped and started again. Batches have to come in order of time, as files of a feed do; rows later than the
watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed values, in minutes: a lease without heartbeat, and the waits after a passing and any other error.
LEASE, PASSING, OTHER = 15, (10, 3), 2
MINUTE = 60_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = "{key} long, job long, at long, step int, change string, attempt int"
_JOBS = "job array<long>, urgent array<boolean>, available array<long>, status array<string>, attempt array<int>, beat array<long>, timer long"


def backoff(attempt: int, passing: bool) -> int:
    """Milliseconds until the next attempt."""
    return MINUTE * (PASSING[0] * PASSING[1] ** max(0, attempt - 1) if passing else OTHER**attempt)


class OpenJobs:
    """The open jobs of a queue: number -> [urgent, available, status, attempt, beat].

    What is looked for stands in heaps: what happens by itself, free jobs, running ones. An entry that no longer says what
    its job is gets passed over, so a row costs the logarithm of the queue's length.
    """

    def __init__(self, jobs: dict[int, list], most: int):
        self.jobs, self.most, self.changes = jobs, most, []
        self._ends, self._free, self._heard = [], {True: [], False: []}, []
        for n in jobs:
            self._note(n)

    def _note(self, n: int) -> None:
        urgent, available, status, _, beat = self.jobs[n]
        if status == "running":
            heappush(self._ends, (beat + LEASE * MINUTE, n))
            heappush(self._heard, (-beat, -n))
            return
        heappush(self._free[bool(urgent)], (available, n))
        if status == "waiting":
            heappush(self._ends, (available, n))

    def _told(self, job: int, at: int, change: str) -> None:
        self.changes.append((job, at, change, self.jobs[job][3]))

    def due(self) -> tuple[int, int] | None:
        """(time, job) of what happens by itself first: a lease that ends, a wait that is over."""
        while self._ends:
            at, n = self._ends[0]
            job = self.jobs.get(n)
            if job and at == (job[4] + LEASE * MINUTE if job[2] == "running" else job[1] if job[2] == "waiting" else None):
                return at, n
            heappop(self._ends)
        return None

    def advance(self, now: int) -> None:
        """All that is due before now, in order. A job whose lease ended may be claimed at once."""
        while (due := self.due()) and due[0] < now:
            at, n = due
            job = self.jobs[n]
            if job[2] == "running":
                job[1], job[2] = at, "ready"
                self._note(n)
                self._told(n, at, "expired")
            else:
                job[2] = "ready"
                self._told(n, at, "ready")

    def _first_free(self, at: int) -> int | None:
        """Urgent jobs first, then those free longest, then by number."""
        for urgent in (True, False):
            free = self._free[urgent]
            while free:
                available, n = free[0]
                job = self.jobs.get(n)
                if job and job[2] in ("ready", "waiting") and job[1] == available and bool(job[0]) == urgent:
                    if available <= at:
                        return n
                    break
                heappop(free)
        return None

    def _running(self) -> int | None:
        """The job that was claimed or heard of last."""
        while self._heard:
            beat, n = -self._heard[0][0], -self._heard[0][1]
            job = self.jobs.get(n)
            if job and job[2] == "running" and job[4] == beat:
                return n
            heappop(self._heard)
        return None

    def apply(self, number: int, at: int, kind: str, flag: bool) -> None:
        self.advance(at)
        if kind == "add":
            if number not in self.jobs:
                self.jobs[number] = [flag, at, "ready", 0, 0]
                self._note(number)
                self._told(number, at, "queued")
            return
        if kind == "claim":
            n = self._first_free(at)
            if n is not None:
                self.jobs[n][2:] = ["running", self.jobs[n][3] + 1, at]
                self._note(n)
                self._told(n, at, "claimed")
            return
        n = self._running()
        if n is None:
            return
        job = self.jobs[n]
        if kind == "beat":
            job[4] = at
            self._note(n)
        elif kind == "done" or job[3] >= self.most:
            self._told(n, at, "done" if kind == "done" else "failed")
            del self.jobs[n]
        else:
            job[1], job[2] = at + backoff(job[3], flag), "waiting"
            self._note(n)
            self._told(n, at, "retry")


class QueueProcessor(StatefulProcessor):
    """Each queue's open jobs are one value, with the time of its timer, so that a batch reads and writes it once."""

    def __init__(self, key: str, most: int):
        self.row, self.most = Row(key, "job", "at", "step", "change", "attempt"), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", _JOBS)

    def _run(self, key, act, fired: bool = False) -> Iterator[Row]:
        *columns, timer = self.state.get() or ([],) * 6 + (None,)
        known = list(zip(*columns))
        open_jobs = OpenJobs({n: list(job) for n, *job in known}, self.most)
        act(open_jobs)
        due = open_jobs.due()
        # What is due at a time happens before a later one; a timer that fired is gone.
        wanted, set_ = due[0] + 1 if due else None, None if fired else timer
        if set_ != wanted:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        now = [(n, *job) for n, job in open_jobs.jobs.items()]
        if not now:
            if known:
                self.state.clear()
        elif now != known or wanted != timer:
            self.state.update((*map(list, zip(*now)), wanted))
        for i, (n, at, change, attempt) in enumerate(open_jobs.changes):
            yield self.row(int(key[0]), n, at, i, change, attempt)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted((row.ms, row.number, row.kind, row.flag) for row in rows)

        def act(jobs: OpenJobs) -> None:
            for ms, number, kind, flag in new:
                jobs.apply(number, ms, kind, flag)

        yield from self._run(key, act)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._run(key, lambda jobs: jobs.advance(timerValues.getCurrentWatermarkInMs()), fired=True)

    def close(self) -> None:
        pass


def queue_transitions(rows: DataFrame, *, key: str, number: str, at: str, kind: Column, flag: Column, late: str = "1 second", most: int = 3) -> DataFrame:
    """A stream of (key, job, at, step, change, attempt) from a stream of rows; at in milliseconds.

    kind: add (the row's number becomes a job; flag: urgent), claim (the first free job: urgent ones, then those free
    longest, then by number), beat (the running job's lease begins anew), done, fail (flag: an error that passes). done, fail
    and beat are about the job that was claimed or heard of last. A job fails for good at its `most`-th attempt. changes:
    queued, claimed, retry, ready, expired, done, failed; `step` orders those of a queue in one micro-batch.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = F.floor(F.unix_micros(F.col(at)) / 1000).cast("long")
    known = rows.withWatermark(at, late).select(F.col(key).cast("long").alias(key), F.col(number).cast("long").alias("number"), ms.alias("ms"), kind.alias("kind"), F.coalesce(flag, F.lit(False)).alias("flag"), at)
    return known.where("kind IS NOT NULL").groupBy(key).transformWithState(
        statefulProcessor=QueueProcessor(key, most), outputStructType=TRANSITIONS.format(key=key), outputMode="Append", timeMode="EventTime")
