"""Stateful and incremental operators (SM), writes (SNK) and change feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import backoff_minutes
from palimpsest.operators.compare import insert_absent, upsert
from palimpsest.operators.feed import event_kind, sequenced
from palimpsest.operators.incremental import barrier_open, claim, cross_check_reason, is_transient, stale_to_retry, trailing_count
from palimpsest.operators.latest import fold_latest, islands, missing_counter
from palimpsest.plans.registry import query, table

_NOW = "1996-06-01"


@query("SM-01_queue_claim", """
SELECT o_orderkey, 'running' AS status, 1 AS attempt FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1996-06-01'
ORDER BY (o_orderpriority <> '1-URGENT'), o_orderdate, o_orderkey LIMIT 25""")
def queue_claim(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).withColumn("attempt", F.lit(0))
    found = claim(jobs, now=F.lit(_NOW).cast("timestamp_ntz"), available="o_orderdate", first=F.col("o_orderpriority") == "1-URGENT", key="o_orderkey", batch=25)
    return found.select("o_orderkey", "status", "attempt")


@query("SM-02_stale_lease", """
SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE THEN 'retry' ELSE event_type END AS status FROM events""")
def stale_lease(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), "ts")
    return stale_to_retry(rows, status="status", running="view", heartbeat="ts", now=F.lit("2024-01-15").cast("timestamp_ntz"), minutes=15).select("event_id", "status")


@query("SM-04_job_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'click') AS attempts FROM events GROUP BY user_id")
def job_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "click").alias("attempts"))


@query("SM-05_backoff", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN 10 * power(3, l_linenumber - 1) ELSE power(2, l_linenumber) END AS BIGINT) AS minutes FROM lineitem""")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", backoff_minutes(F.col("l_linenumber"), F.col("l_returnflag") == "R").alias("minutes"))


@query("SM-06_transient_errors", """
SELECT event_id, (CAST(json_extract_string(props, '$.k') AS INT) IN (8, 25, 29)) OR event_type IN ('error', 'timeout') OR regexp_matches(lower(props), 'timed? ?out|connection|rate limit|overloaded') AS transient FROM events""")
def transient_errors(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", is_transient(k, F.col("event_type"), F.col("props"), codes=(8, 25, 29), kinds=("error", "timeout")).alias("transient"))


@query("SM-07_barrier", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linestatus = 'O') = 0")
def barrier(spark, sf_dir):
    return barrier_open(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "O")


@query("SM-08_change_detection", """
WITH f AS (SELECT user_id, event_id, ts, coalesce(CASE WHEN value >= 20 THEN event_type END,
  last_value(CASE WHEN value >= 20 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS hash FROM events)
SELECT event_id, hash, hash IS DISTINCT FROM lag(hash) OVER w OR row_number() OVER w = 1 AS changed FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_detection(spark, sf_dir):
    from palimpsest.operators.incremental import inherit_missing

    events = table(spark, sf_dir, "events").withColumn("seen", F.when(F.col("value") >= 20, F.col("event_type")))
    hashed = inherit_missing(events, ["user_id"], [F.col("ts"), F.col("event_id")], "seen", "hash")
    return islands(hashed, ["user_id"], [F.col("ts"), F.col("event_id")], "hash").select("event_id", "hash", "changed")


@query("SM-09_revision_numbers", """
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM c""")
def revision_numbers(spark, sf_dir):
    return islands(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "revision")


@query("SM-10_missing_counter", """
WITH s AS (SELECT *, event_type <> 'view' AS seen, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM events),
m AS (SELECT *, CAST(sum((NOT seen)::INT) OVER (PARTITION BY user_id, streak ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS missing FROM s)
SELECT event_id, missing, CASE WHEN missing = 0 THEN 'available' WHEN missing >= 3 THEN 'unavailable' ELSE 'uncertain' END AS availability FROM m""")
def missing_counter_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("seen", F.col("event_type") != "view")
    return missing_counter(events, ["user_id"], [F.col("ts"), F.col("event_id")], "seen").select("event_id", "missing", "availability")


@query("SM-11_first_last_seen", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) FILTER (WHERE event_type = 'purchase') AS last_verified FROM events GROUP BY user_id")
def first_last_seen(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_verified"))


@query("SM-12_abandoned_runs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-06-01' - INTERVAL 6 HOUR")
def abandoned_runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit(_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOUR"))).select("o_orderkey")


@query("SM-13_schedule", """
SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1996-06-01' - INTERVAL 20 DAY)))""")
def schedule(spark, sf_dir):
    busy = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "P") | ((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") > F.lit(_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 20 DAY"))))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(busy, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SM-14_rate_limit", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events""")
def rate_limit(spark, sf_dir):
    return trailing_count(table(spark, sf_dir, "events"), ["user_id"], "ts", seconds=24 * 3600, name="recent").select("event_id", "recent")


@query("SM-15_usage_by_minute", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def usage_by_minute(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))


@query("SM-16_idempotent_requests", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id")
def idempotent_requests(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SM-17_expiry", """
SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'expired' WHEN event_type = 'view' AND ts <= TIMESTAMP '2024-01-20' - INTERVAL 330 SECOND THEN 'stale' ELSE 'live' END AS state FROM events""")
def expiry(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    state = F.when(F.col("ts") <= now - F.expr("INTERVAL 24 HOUR"), "expired").when((F.col("event_type") == "view") & (F.col("ts") <= now - F.expr("INTERVAL 330 SECOND")), "stale").otherwise("live")
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("SM-18_change_feed", """
WITH s AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS prev, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'created' WHEN event_type = 'purchase' THEN 'extended' WHEN event_type = 'error' THEN 'cancelled' WHEN prev = 'error' THEN 'restored' ELSE 'updated' END AS kind
FROM s WHERE n = 1 OR event_type IS DISTINCT FROM prev""")
def change_feed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return event_kind(events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", {"purchase": "extended", "error": "cancelled"}, restored_from="error").select("event_id", "kind")


@query("SM-19_commit_sequence", "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS event_seq FROM orders")
def commit_sequence(spark, sf_dir):
    return sequenced(table(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], after=1000).select("o_orderkey", "event_seq")


@query("SM-20_memo_by_hash", """
WITH u AS (SELECT DISTINCT sha256(text) AS sha, text FROM documents) SELECT doc_id, length(u.text) AS transcript_length FROM documents d JOIN u ON sha256(d.text) = u.sha""")
def memo_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    memo = docs.groupBy("sha").agg(F.max(F.length("text")).cast("bigint").alias("transcript_length"))
    return docs.select("doc_id", "sha").join(memo, "sha").select("doc_id", "transcript_length")


@query("SM-21_reuse", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_partkey = l.l_partkey AND d.l_suppkey = l.l_suppkey AND d.l_linestatus = 'F')""")
def reuse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return insert_absent(lines.where("l_linestatus = 'F'"), lines.select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("SM-23_cross_check_policy", """
SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN coalesce(quality, 1) = 0 THEN 'coverage' WHEN len(string_split(text, chr(10))) >= 20 THEN 'many' WHEN n_chars >= 20000 THEN 'long' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)""")
def cross_check_policy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", cross_check_reason(F.col("n_chars"), F.coalesce("quality", F.lit(1)) == 0, F.size(F.split("text", "\n", -1)), many=20, long=20_000).alias("reason"))


@query("SM-24_import_fifo", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def import_fifo(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("SNK-01_content_addressed", "SELECT sha, min('sha256/' || substr(sha, 1, 2) || '/' || substr(sha, 3, 2) || '/' || sha) AS path FROM (SELECT sha256(text) AS sha FROM documents) GROUP BY sha")
def content_addressed(spark, sf_dir):
    from palimpsest.sources.store import addressed

    return addressed(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"))).select("sha", "path")


@query("SNK-02_copy_children", "SELECT l_orderkey + 1000000 AS version, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey <= 100 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def copy_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), "l_linenumber", "l_partkey")
    return lines.where("version <= 100").withColumn("version", F.col("version") + 1_000_000).unionByName(lines)


@query("SNK-03_upsert", """
WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, o.k IS NOT NULL AS existed FROM o FULL JOIN n ON o.k = n.k""")
def upsert_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"))
    best = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    return upsert(best(orders.where("y < 1996")), best(orders.where("y >= 1996")), ["k"], {"v": lambda old, new: F.coalesce(new, old)}).select("k", "v", "existed")


@query("SNK-04_insert_absent", "SELECT DISTINCT user_id AS k FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def insert_absent_query(spark, sf_dir):
    return insert_absent(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), ["k"])


@query("SNK-05_conditional_upsert", """
SELECT o.o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice <> s THEN s ELSE o_totalprice END AS price
FROM orders o JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) x ON x.l_orderkey = o.o_orderkey""")
def conditional_upsert(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    both = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    replace = (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") != F.col("s"))
    return both.select("o_orderkey", F.when(replace, F.col("s")).otherwise(F.col("o_totalprice")).alias("price"))


@query("SNK-06_new_binaries", "SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def new_binaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return insert_absent(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").select("sha"), ["sha"])


@query("SNK-07_publication_rows", """
SELECT o_orderkey, 'published' AS lifecycle FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 0
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def publication_rows(spark, sf_dir):
    drafts = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_totalprice > 0")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return drafts.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", F.lit("published").alias("lifecycle"))


@query("SNK-08_json_rows", """
SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS body FROM orders""")
def json_rows(spark, sf_dir):
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))


@query("SNK-11_retention", "SELECT event_id FROM events WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20'")
def retention(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") + F.expr("INTERVAL 10 DAY") > F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("SRC-09_current_versions", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current_version FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def current_versions(spark, sf_dir):
    return fold_latest(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey"]).withColumnRenamed("o_orderkey", "current_version")


@query("SRC-10_current_chunks", "SELECT doc_id, vec_id FROM documents JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1")
def current_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").where("coalesce(quality, 1) = 1")
    return docs.join(table(spark, sf_dir, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "vec_id")


@query("SRC-11_feed_scan", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 200")
def feed_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id > 100").orderBy("event_id").limit(200).select("event_id", "event_type")


@query("SRC-01_bound_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def bound_parameters(spark, sf_dir):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 150000, "status": "O"}, orders=table(spark, sf_dir, "orders"))


@query("SM-22_revalidate", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, arg_min(event_id, r) AS event_id FROM l WHERE r <= 3 AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY user_id""")
def revalidate(spark, sf_dir):
    from palimpsest.functions.json import lenient_json
    from palimpsest.operators.latest import latest_by

    last = latest_by(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], keep=3)
    valid = last.where(F.get_json_object(lenient_json(F.col("props")), "$.k").cast("bigint") >= 50)
    return valid.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
