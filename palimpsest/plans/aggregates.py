"""Aggregations (AG) and windows (WN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators.latest import fold_latest, latest_by, next_numbers
from palimpsest.plans.registry import query, table


@query("AG-01_count_by_group", "SELECT o_orderstatus, count(*) AS n_orders FROM orders GROUP BY o_orderstatus")
def count_by_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))


@query("AG-02_filtered_counts", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large, count(*) AS n FROM events GROUP BY user_id""")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("large"), F.count("*").alias("n"))


@query("AG-03_filtered_extremes", "SELECT l_suppkey, min(l_shipdate) FILTER (WHERE l_linestatus = 'O') AS first_open, max(l_shipdate) AS last FROM lineitem GROUP BY l_suppkey")
def filtered_extremes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.min(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))).alias("first_open"), F.max("l_shipdate").alias("last"))


@query("AG-04_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("AG-05_boilerplate", """
SELECT md5(line) AS line_md5, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 5""")
def boilerplate(spark, sf_dir):
    from palimpsest.operators.blocks import boilerplate_lines

    found = boilerplate_lines(table(spark, sf_dir, "documents"), key="doc_id", text="text", at_least=5)
    return found.select(F.md5("line").alias("line_md5"), F.col("n").alias("docs"))


@query("AG-06_duplicates", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("AG-07_best_with_columns", "SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order FROM orders GROUP BY o_custkey")
def best_with_columns(spark, sf_dir):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", F.col("x.o_totalprice").alias("best"), (-F.col("x.k")).alias("best_order"))


@query("AG-08_next_numbers", """
SELECT o_orderkey, coalesce((SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), 0) + row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice) AS number FROM orders""")
def next_numbers_query(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("last"))
    return next_numbers(table(spark, sf_dir, "orders"), ["o_orderkey"], [F.col("o_totalprice")], base, "last").select("o_orderkey", "number")


@query("AG-09_joined_strings", "SELECT user_id, string_agg(DISTINCT event_type, ' / ' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def joined_strings(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), " / ").alias("types"))


@query("AG-10_json_list", """
SELECT l_orderkey, '[' || string_agg('{"n":' || l_linenumber || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']' AS lines FROM lineitem GROUP BY l_orderkey""")
def json_list(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(rows).alias("lines"))


@query("AG-11_json_list_default", """
SELECT c_custkey, coalesce('[' || string_agg('{"k":' || o_orderkey || '}', ',' ORDER BY o_orderkey) || ']', '[]') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def json_list_default(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"))))).alias("j"))
    return table(spark, sf_dir, "customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("j", F.lit("[]")).alias("orders"))


@query("AG-12_funnel", """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM labels WHERE quality = 1) AS good,
  (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations""")
def funnel(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("documents").agg(F.count("*").alias("documents")), t("labels").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good")),
        t("embeddings").agg(F.count("*").alias("vectors")), t("pages").agg(F.count("*").alias("pages")), t("conversations").agg(F.countDistinct("conv_id").alias("conversations"))]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


@query("AG-13_coverage", """
SELECT lang, count(*) AS total, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS share FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang""")
def coverage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("total"), F.count("has").alias("labelled"), F.round(F.count("has") / F.count("*"), 6).alias("share"))


@query("AG-14_bool_or", "SELECT l_orderkey, bool_or(l_quantity > 45) AS any_large, bool_and(l_discount < 0.09) AS all_low FROM lineitem GROUP BY l_orderkey")
def bool_or(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("any_large"), F.bool_and(F.col("l_discount") < 0.09).alias("all_low"))


@query("AG-15_signature_sets", """
WITH s AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS signature FROM orders GROUP BY 1)
SELECT signature, count(*) AS customers FROM s GROUP BY signature""")
def signature_sets(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("signature"))
    return s.groupBy("signature").agg(F.count("*").alias("customers"))


@query("WN-01_total_beside_page", "SELECT p_partkey, count(*) OVER () AS total FROM part WHERE p_size > 20 ORDER BY p_partkey LIMIT 25")
def total_beside_page(spark, sf_dir):
    found = table(spark, sf_dir, "part").where("p_size > 20")
    return found.select("p_partkey").orderBy("p_partkey").limit(25).crossJoin(found.agg(F.count("*").alias("total")))


@query("WN-02_count_per_outer", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem")
def count_per_outer(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(Window.partitionBy("l_orderkey")).alias("lines"))


@query("WN-03_latest_by_key", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_by_key(spark, sf_dir):
    return fold_latest(table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), ["event_id", "event_type"])


@query("WN-04_null_is_a_group", """
SELECT DISTINCT ON (quality) quality, doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality, n_chars DESC, doc_id""")
def null_is_a_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return latest_by(docs, ["quality"], [F.col("n_chars").desc(), F.col("doc_id")]).select("quality", "doc_id")
