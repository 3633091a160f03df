"""The queue's stream against a fold over all rows: for any cut into micro-batches, and after a restart."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.streams import queue_of_events
from palimpsest.streaming.incremental import feed_in_order, run_to_end
from palimpsest.streaming.queue import backoff

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1)


def _events(n, seed):
    r = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += r.choice([0, 1, 700, 40_000, 240_000])  # milliseconds, some at one moment
        kind = r.choices(["signup", "click", "view", "purchase", "error", "other"], [5, 6, 3, 1, 4, 1])[0]
        rows.append((i, START + timedelta(milliseconds=at), r.choice([1, 1, 1, 2, 3]), kind, r.choice([None, 5.0, 20.0, 35.0])))
    return rows


def _fold(events):
    """All transitions by replaying the rows of each queue in order; what is due happens before a later row."""
    ms = lambda t: round((t - START).total_seconds() * 1000)
    told, end = [], max(ms(e[1]) for e in events) - 1000
    for user in {e[2] for e in events}:
        jobs = []

        def tell(job, at, change, user=user):
            told.append((user, job["n"], at, change, job["tries"]))

        def settle(now, jobs=jobs, tell=tell):
            while True:
                due = [(j["beat"] + 900_000, j["n"], j) for j in jobs if j["is"] == "running"] + [(j["free"], j["n"], j) for j in jobs if j["is"] == "waiting"]
                due = sorted((x for x in due if x[0] < now), key=lambda x: x[:2])
                if not due:
                    return
                at, _, job = due[0]
                tell(job, at, "expired" if job["is"] == "running" else "ready")
                job.update({"free": at} if job["is"] == "running" else {})
                job["is"] = "ready"

        for n, t, _, kind, value in sorted((e for e in events if e[2] == user), key=lambda e: (ms(e[1]), e[0])):
            now = ms(t)
            if kind == "other":
                continue
            settle(now)
            if kind == "signup":
                jobs.append({"n": n, "urgent": bool(value and value >= 30), "free": now, "is": "ready", "tries": 0, "beat": 0})
                tell(jobs[-1], now, "queued")
                continue
            if kind == "click":
                free = sorted((j for j in jobs if j["is"] != "running" and j["free"] <= now), key=lambda j: (not j["urgent"], j["free"], j["n"]))
                if free:
                    free[0].update({"is": "running", "beat": now, "tries": free[0]["tries"] + 1})
                    tell(free[0], now, "claimed")
                continue
            running = sorted((j for j in jobs if j["is"] == "running"), key=lambda j: (j["beat"], j["n"]))
            if not running:
                continue
            job = running[-1]
            if kind == "view":
                job["beat"] = now
            elif kind == "purchase" or job["tries"] >= 3:
                tell(job, now, "done" if kind == "purchase" else "failed")
                jobs.remove(job)
            else:
                wait = 10 * 3 ** (job["tries"] - 1) if value is not None and value < 15 else 2 ** job["tries"]
                job.update({"is": "waiting", "free": now + wait * 60_000})
                tell(job, now, "retry")
        settle(end)
    return sorted(told)


def _told(found):
    zero = round(START.timestamp() * 1000)
    return sorted((r.user_id, r.job, r["at"] - zero, r.change, r.attempt) for r in found.collect())


def _stream(spark, path):
    return queue_of_events(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))


@pytest.mark.parametrize("files", [1, 5])
def test_transitions_are_those_of_a_fold(spark, files):
    events = _events(500, 2)
    path = feed_in_order(spark.createDataFrame(events, SCHEMA).repartition(3), at="ts", files=files)
    found, wanted = _told(run_to_end(_stream(spark, path), tempfile.mkdtemp(prefix="spark-", dir="/tmp"))), _fold(events)
    assert found == wanted and {x[3] for x in wanted} == {"queued", "claimed", "retry", "ready", "expired", "done", "failed"}


def test_a_restart_goes_on_where_the_stream_stopped(spark):
    events = _events(400, 3)
    df, out = spark.createDataFrame(events, SCHEMA), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    half = events[200][1]
    path = feed_in_order(df.where(F.col("ts") <= F.lit(half)), at="ts", files=2)
    first = _told(run_to_end(_stream(spark, path), out))
    df.where(F.col("ts") > F.lit(half)).coalesce(1).write.mode("append").parquet(path)
    assert 0 < len(first) < len(_fold(events)) and _told(run_to_end(_stream(spark, path), out)) == _fold(events)


def test_backoff():
    assert [backoff(n, True) // 60_000 for n in (1, 2, 3)] == [10, 30, 90] and [backoff(n, False) // 60_000 for n in (1, 2, 3)] == [2, 4, 8]
