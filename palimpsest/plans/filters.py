"""Predicates of the filtered search (FLT) on orders, line items, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.dates import deadline_bucket
from palimpsest.operators.predicates import array_member, bidirectional_prefix, exists_child, optional_equals, question_filters, restricted_or_match, status_filter, with_explicit
from palimpsest.plans.registry import query, table


@query("FLT-01_freshness_flag", """
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 100 DAY) AS is_stale
FROM orders""")
def freshness_flag(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    late = lines.join(orders, lines.l_orderkey == orders.o_orderkey).where(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 100 DAY")).select("o_orderkey").distinct().withColumn("late", F.lit(True))
    return orders.select("o_orderkey").join(late, "o_orderkey", "left").select("o_orderkey", F.coalesce("late", F.lit(False)).alias("is_stale"))


@query("FLT-02_array_member", """
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_contains(list(DISTINCT l_returnflag), 'R')""")
def array_member_query(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.where(array_member("flags", "R")).select("l_orderkey")


@query("FLT-03_substring_any_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%'")
def substring_any_case(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%an%")).select("p_partkey", "p_name")


@query("FLT-04_independent_ranges", """
SELECT o_orderkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= TIMESTAMP '1996-01-01')
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 40)
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate <= TIMESTAMP '1997-12-31')""")
def independent_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = table(spark, sf_dir, "orders")
    for condition in (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("l_quantity") >= 40, F.col("l_shipdate") <= F.lit("1997-12-31").cast("timestamp_ntz")):
        found = exists_child(found, lines, "o_orderkey", "l_orderkey", condition)
    return found.select("o_orderkey")


@query("FLT-05_exists_kind", """
SELECT c_custkey FROM customer WHERE EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = CASE WHEN 'urgent' = 'urgent' THEN '1-URGENT' ELSE 'urgent' END)""")
def exists_kind(spark, sf_dir):
    kind = {"urgent": "1-URGENT"}.get("urgent", "urgent")
    return exists_child(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", F.col("o_orderpriority") == kind).select("c_custkey")


@query("FLT-06_interval_overlap", """
SELECT s_suppkey FROM supplier WHERE EXISTS (
  SELECT 1 FROM (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey) x
  WHERE x.l_suppkey = s_suppkey AND hi >= 50000 AND lo <= 1500)""")
def interval_overlap(spark, sf_dir):
    span = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return exists_child(table(spark, sf_dir, "supplier"), span, "s_suppkey", "l_suppkey", (F.col("hi") >= 50000) & (F.col("lo") <= 1500)).select("s_suppkey")


@query("FLT-07_unknown_passes", """
SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'F' THEN 'restricted' WHEN 'O' THEN 'unrestricted' ELSE 'unknown' END <> 'restricted'
  OR list_contains(['1-URGENT', '2-HIGH'], o_orderpriority)""")
def unknown_passes(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "restricted").when(F.col("o_orderstatus") == "O", "unrestricted").otherwise("unknown")
    allowed = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return table(spark, sf_dir, "orders").where(restricted_or_match(status, F.array_contains(allowed, F.col("o_orderpriority")))).select("o_orderkey")


@query("FLT-08_prefix_both_ways", """
SELECT n_nationkey FROM nation WHERE starts_with(n_name, 'NATION_1') OR starts_with('NATION_1', n_name)""")
def prefix_both_ways(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(bidirectional_prefix(F.array("n_name"), "NATION_1")).select("n_nationkey")


@query("FLT-09_unknown_excluded", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <= 1000")
def unknown_excluded(spark, sf_dir):
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") <= 1000)).select("c_custkey")


_STATUS = """
SELECT o_orderkey FROM orders o WHERE {}"""


@query("FLT-10_status_active", _STATUS.format("""o_orderstatus <> 'F' AND EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '1997-01-01'
    AND (l_returnflag <> 'N' OR l_shipdate + INTERVAL 900 DAY >= TIMESTAMP '1997-01-01'))"""))
def status_active(spark, sf_dir):
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    window = (F.col("l_linestatus") == "O") & (F.col("l_shipdate") <= now) & ((F.col("l_returnflag") != "N") | (F.col("l_shipdate") + F.expr("INTERVAL 900 DAY") >= now))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return exists_child(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", window).select("o_orderkey")


@query("FLT-11_status_closed", _STATUS.format("EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1995-06-01')"))
def status_closed(spark, sf_dir):
    return exists_child(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("FLT-12_status_cancelled", _STATUS.format("o_orderstatus = 'F'"))
def status_cancelled(spark, sf_dir):
    return status_filter(table(spark, sf_dir, "orders"), "cancelled", {"cancelled": F.col("o_orderstatus") == "F"}).select("o_orderkey")


@query("FLT-13_status_unrecognized", _STATUS.format("true"))
def status_unrecognized(spark, sf_dir):
    return status_filter(table(spark, sf_dir, "orders"), "upcoming", {"cancelled": F.col("o_orderstatus") == "F"}).select("o_orderkey")


#: Questions about customers, and the filters that each states by construction.
_ASKED = "CASE c_custkey % 4 WHEN 0 THEN '서울특별시 거주 대학생 등록금' WHEN 1 THEN '경상남도에 사는 석사, ' || CAST(1 + c_custkey % 50 AS {s}) || '만원 이상' WHEN 2 THEN '소득 ' || CAST(c_custkey % 10 AS {s}) || '구간 이하 이번 달 신청 가능' ELSE c_name END"


@query("FLT-14_question_filters", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'undergraduate' WHEN 1 THEN 'graduate' END AS student_type, CASE WHEN c_custkey % 4 = 0 THEN 'tuition' END AS benefit_type,
  CASE WHEN c_custkey % 4 = 2 THEN 'active' END AS status, CASE WHEN c_custkey % 4 = 2 THEN DATE '1996-02-10' END AS end_from, CASE WHEN c_custkey % 4 = 2 THEN DATE '1996-02-29' END AS end_to,
  CASE WHEN c_custkey % 4 = 1 THEN (1 + c_custkey % 50) * 10000 END AS min_amount, CASE WHEN c_custkey % 4 = 2 THEN c_custkey % 10 END AS income_bracket_max,
  CASE WHEN c_acctbal > 5000 THEN '부산' WHEN c_custkey % 4 = 0 THEN '서울' WHEN c_custkey % 4 = 1 THEN '경남' END AS region FROM customer""")
def question_filters_query(spark, sf_dir):
    found = question_filters(F.expr(_ASKED.format(s="STRING")), F.lit("1996-02-10").cast("date"))
    merged = with_explicit(found, {"region": F.when(F.col("c_acctbal") > 5000, F.lit("부산"))})
    return table(spark, sf_dir, "customer").select("c_custkey", merged.alias("f")).select("c_custkey", "f.*")


@query("FLT-15_optional_equals", "SELECT c_custkey FROM customer WHERE ('' = '' OR c_mktsegment = '') AND ('MACHINERY' = '' OR c_mktsegment = 'MACHINERY')")
def optional_equals_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return optional_equals(optional_equals(customers, "c_mktsegment", ""), "c_mktsegment", "MACHINERY").select("c_custkey")


@query("FLT-16_three_column_search", "SELECT p_partkey FROM part WHERE coalesce(p_name, '') ILIKE '%steel%' OR coalesce(p_brand, '') ILIKE '%#1%' OR coalesce(p_type, '') ILIKE '%promo%'")
def three_column_search(spark, sf_dir):
    wanted = {"p_name": "%steel%", "p_brand": "%#1%", "p_type": "%promo%"}
    match = F.lit(False)
    for c, pattern in wanted.items():
        match = match | F.coalesce(F.col(c), F.lit("")).ilike(pattern)
    return table(spark, sf_dir, "part").where(match).select("p_partkey")


@query("FLT-17_deadline_bucket", """
SELECT l_orderkey, CASE WHEN max(l_shipdate) IS NULL THEN 'unknown' WHEN CAST(max(l_shipdate) AS DATE) < DATE '1996-06-01' THEN 'closed'
  WHEN CAST(max(l_shipdate) AS DATE) <= DATE '1996-06-15' THEN 'closing' ELSE 'open' END AS bucket FROM lineitem GROUP BY l_orderkey""")
def deadline_bucket_query(spark, sf_dir):
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("d"))
    return last.select("l_orderkey", deadline_bucket(F.col("d"), F.lit("1996-06-01").cast("date")).alias("bucket"))


@query("FLT-18_stage_filter", """
SELECT o.o_orderkey, x.pending FROM orders o JOIN (
  SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS pending FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey WHERE x.pending > 2""")
def stage_filter(spark, sf_dir):
    pending = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("pending")).where("pending > 2")
    return table(spark, sf_dir, "orders").join(pending, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "pending")


@query("FLT-19_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3][0-9]*$')")
def regex(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_brand").rlike("^Brand#[1-3][0-9]*$")).select("p_partkey")


@query("FLT-20_null_safe", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def null_safe(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").where(~F.col("toxic").eqNullSafe(F.lit(1))).select("doc_id")


@query("FLT-21_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")


@query("FLT-22_lists", """
SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def lists(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    blocked = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return events.join(blocked, "user_id", "left_anti").select("event_id")


@query("FLT-23_scope_gate", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang = 'en') * 2 > count(*))")
def scope_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    scope = docs.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("n")).where("en * 2 > n").select("source")
    return docs.join(scope, "source", "left_semi").select("doc_id")


@query("FLT-24_column_privacy", "SELECT doc_id, CASE WHEN coalesce(quality = 1, false) THEN length(text) END AS shown_length FROM documents LEFT JOIN labels USING (doc_id)")
def column_privacy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.when(F.coalesce(F.col("quality") == 1, F.lit(False)), F.length("text").cast("bigint")).alias("shown_length"))


@query("FLT-25_view_registry", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def view_registry(spark, sf_dir):
    for name in ("region", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"admin_{name}")
    return spark.sql("SELECT r_name, count(*) AS nations FROM admin_region JOIN admin_nation ON n_regionkey = r_regionkey GROUP BY r_name")
