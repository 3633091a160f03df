"""Streaming forms of the incremental operators, on events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.plans.registry import query, table
from palimpsest.operators.lineage import shared_folder
from palimpsest.streaming.incremental import first_requests, missing_streaks, run_to_end, settle, slices_in_order, stream_table, tumbling_counts


@query("SM-15_stream_usage", "SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_usage(spark, sf_dir):
    counted = tumbling_counts(stream_table(spark, sf_dir, "events"), keys=["event_type"], at="ts", width="1 minute", late="30 days")
    return settle(counted, ["event_type", "start"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SM-16_stream_requests", "SELECT DISTINCT user_id, event_type FROM events")
def stream_requests(spark, sf_dir):
    first = first_requests(stream_table(spark, sf_dir, "events"), keys=["user_id", "event_type"], at="ts", late="60 days")
    return settle(first.select("user_id", "event_type"), ["user_id", "event_type"], mode="append")


@query("SM-10_stream_missing", """
WITH o AS (SELECT user_id, event_type = 'view' AS miss, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, coalesce(min(r) FILTER (WHERE NOT miss) - 1, count(*)) AS missing FROM o GROUP BY user_id""")
def stream_missing(spark, sf_dir):
    rows = stream_table(spark, sf_dir, "events").withColumn("seen", F.col("event_type") != "view")
    return settle(missing_streaks(rows, key="user_id", at="ts", tie="event_id", seen="seen"), ["user_id"])


#: What an event is to its user's queue of jobs.
KINDS = {"signup": "add", "click": "claim", "view": "beat", "purchase": "done", "error": "fail"}


def queue_of_events(rows):
    """The transitions of the queues of users: signups are jobs, urgent from 30 up; errors under 15 pass by themselves."""
    from palimpsest.streaming.queue import queue_transitions

    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    flag = F.when(F.col("event_type") == "error", F.col("value") < 15).otherwise(F.col("value") >= 30)
    return queue_transitions(rows, key="user_id", number="event_id", at="ts", kind=kind, flag=flag)


@query("SM-01_stream_queue")
def stream_queue(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path, out = (f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("feed", "stream"))
    # Each part is written by all tasks; the stream takes it whole and goes on from there with the next.
    for part in slices_in_order(events, at="ts", parts=4):
        part.write.mode("append").parquet(path)
        found = run_to_end(queue_of_events(spark.readStream.schema(events.schema).parquet(path)), out)
    return found.select("user_id", "job", F.timestamp_millis("at").alias("at"), "change", "attempt")
