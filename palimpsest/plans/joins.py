"""Joins (JN), sorting and paging (SO), sets (ST)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions.text import name_similarity
from palimpsest.operators.compare import full_diff, predecessor
from palimpsest.operators.latest import latest_by
from palimpsest.operators.paging import keyset_page, offset_page, page_count
from palimpsest.operators.similarity import trigram_pairs
from palimpsest.plans.registry import query, table

#: Trigrams of x in DuckDB, and name similarity of a and b.
GRAMS = "list_distinct([substr('  ' || {x} || ' ', i, 3) for i in range(1, length({x}) + 2)])"


@query("JN-01_inner_chain", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def inner_chain(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", "c_name", "n_name", "r_name")


@query("JN-02_left", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("JN-03_left_aggregate", """
SELECT c_custkey, coalesce(max(o_totalprice), 0) AS best, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def left_aggregate(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.count("o_orderkey").alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("JN-04_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("JN-05_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("JN-06_in_subquery", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def in_subquery(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("JN-07_lateral_top1", """
SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders LEFT JOIN LATERAL (
  SELECT l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_extendedprice DESC, l_linenumber LIMIT 1) x ON true""")
def lateral_top1(spark, sf_dir):
    top = latest_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")])
    return table(spark, sf_dir, "orders").select("o_orderkey").join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("JN-08_lateral_aggregate", """
SELECT o_orderkey, x.open_lines, x.all_lines FROM orders LEFT JOIN LATERAL (
  SELECT count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) AS all_lines FROM lineitem WHERE l_orderkey = o_orderkey) x ON true""")
def lateral_aggregate(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count("*").alias("a"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("o", F.lit(0)).alias("open_lines"), F.coalesce("a", F.lit(0)).alias("all_lines"))


@query("JN-09_typed_subject", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN c_name ELSE s_name END AS subject FROM events
LEFT JOIN customer ON event_id % 2 = 0 AND c_custkey = user_id LEFT JOIN supplier ON event_id % 2 = 1 AND s_suppkey = user_id""")
def typed_subject(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    events = table(spark, sf_dir, "events").select("event_id", F.when(even, F.col("user_id")).alias("ck"), F.when(~even, F.col("user_id")).alias("sk"))
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return events.join(c, F.col("ck") == F.col("c_custkey"), "left").join(s, F.col("sk") == F.col("s_suppkey"), "left").select("event_id", F.coalesce("c_name", "s_name").alias("subject"))


@query("JN-10_correlated_scalar", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer""")
def correlated_scalar(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("JN-11_either_key", "SELECT DISTINCT e.event_id, c.c_custkey FROM events e JOIN customer c ON c.c_custkey IN (e.user_id, e.event_id)")
def either_key(spark, sf_dir):
    events, customers = table(spark, sf_dir, "events").select("event_id", "user_id"), table(spark, sf_dir, "customer").select("c_custkey")
    by_user = events.join(customers, F.col("user_id") == F.col("c_custkey"))
    by_id = events.join(customers, F.col("event_id") == F.col("c_custkey"))
    return by_user.select("event_id", "c_custkey").union(by_id.select("event_id", "c_custkey")).distinct()


@query("JN-12_trigram_blocking", f"""
WITH d AS (SELECT DISTINCT p_name AS name FROM part WHERE length(p_name) > 0),
g AS (SELECT name, {GRAMS.format(x='name')} AS g FROM d),
p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.g, b.g)) AS s, len(a.g) + len(b.g) AS t FROM g a JOIN g b ON a.name <= b.name)
SELECT x.p_partkey AS left_key, y.p_partkey AS right_key, round(s / (t - s)::DOUBLE, 6) AS similarity
FROM (SELECT a, b, s, t FROM p WHERE s / (t - s)::DOUBLE >= 0.8 UNION ALL SELECT b, a, s, t FROM p WHERE s / (t - s)::DOUBLE >= 0.8 AND a <> b) q
JOIN part x ON x.p_name = q.a JOIN part y ON y.p_name = q.b WHERE x.p_partkey < y.p_partkey""")
def trigram_blocking(spark, sf_dir):
    return trigram_pairs(table(spark, sf_dir, "part"), key="p_partkey", name="p_name", at_least=0.8, digits=6)


#: Of the parts whose key is divisible by 50, the 50 nearest others by name or with an equal program, no supplier shared.
CANDIDATES = f"""
WITH s AS (SELECT p_partkey AS k, p_name || ' ' || p_type AS name, p_brand || p_size AS program FROM part),
n AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey) AS notices FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
g AS (SELECT s.*, {GRAMS.format(x='name')} AS g, coalesce(notices, []) AS notices FROM s LEFT JOIN n USING (k)),
c AS (SELECT a.k AS subject, b.k AS candidate, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS t, a.program = b.program AS same FROM g a JOIN g b ON a.k % 50 = 0 AND a.k <> b.k AND len(list_intersect(a.notices, b.notices)) = 0)
SELECT subject, candidate, i / (t - i)::DOUBLE AS similarity FROM c WHERE same OR i / (t - i)::DOUBLE >= 0.2
QUALIFY row_number() OVER (PARTITION BY subject ORDER BY i / (t - i)::DOUBLE DESC, candidate) <= 50"""


def candidates(spark, sf_dir):
    from palimpsest.operators.similarity import identity_candidates

    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"), F.concat("p_brand", F.col("p_size").cast("string")).alias("program"))
    notices = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return identity_candidates(parts, notices, key="p_partkey", name="name", program="program", notice="l_suppkey", asked=F.col("p_partkey") % 50 == 0)


@query("JN-12_identity_candidates", f"SELECT subject, candidate, round(similarity, 6) AS similarity FROM ({CANDIDATES})")
def identity_candidates_query(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query("JN-13_similarity_ranking", f"""
WITH q AS (SELECT 'brand#11' AS q), s AS (
  SELECT p_partkey, lower(t) AS t FROM part, LATERAL (VALUES (p_brand), (p_type)) v(t)),
g AS (SELECT p_partkey, t, q, {GRAMS.format(x='t')} AS a, {GRAMS.format(x='q')} AS b FROM s, q)
SELECT p_partkey, round(max(CASE WHEN length(t) = 0 THEN 0.0 WHEN t = q THEN 1.0
  WHEN least(length(t), length(q)) >= 6 AND length(t) <> length(q) AND (contains(t, q) OR contains(q, t)) THEN 0.9
  ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END), 6) AS similarity
FROM g GROUP BY p_partkey ORDER BY similarity DESC, p_partkey LIMIT 12""")
def similarity_ranking(spark, sf_dir):
    from palimpsest.operators.similarity import rank_similar

    found = rank_similar(table(spark, sf_dir, "part"), "Brand#11", key="p_partkey", titles=["p_brand", "p_type"], top=12)
    return found.select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query("JN-14_nearest_vectors", """
WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q_id, vec_id, 1 - list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS d FROM q, embeddings WHERE vec_id <> q_id)
SELECT q_id, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(d, 6), vec_id) AS r FROM d) WHERE r <= 10""")
def nearest_vectors(spark, sf_dir):
    from palimpsest.operators.nearest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 50 = 0"), vectors, key="vec_id", vector="embedding", top=10)


@query("JN-15_missing_from_listing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_from_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("JN-16_adjacent_versions", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_o_orderkey, lag(o_totalprice) OVER w AS prev_o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def adjacent_versions(spark, sf_dir):
    found = predecessor(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return found.select("o_orderkey", "prev_o_orderkey", "prev_o_totalprice")


@query("JN-17_full_diff", """
WITH a AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS before, b.v AS after,
  CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def full_diff_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v"))
    return full_diff(year(1995), year(1996), ["o_custkey"], "v")


@query("JN-18_as_of_predecessor", """
SELECT e.event_id, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = e.user_id AND o_orderdate < e.ts) AS last_order FROM events e""")
def as_of_predecessor(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderdate").alias("d"))
    both = events.withColumn("d", F.lit(None).cast("timestamp_ntz")).unionByName(orders.withColumn("event_id", F.lit(None).cast("bigint")))
    # Events sort before orders of the same moment: only earlier ones count.
    rows = Window.partitionBy("k").orderBy("t", F.col("event_id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last_order", F.max("d").over(rows)).where("event_id IS NOT NULL").select("event_id", "last_order")


@query("JN-19_cached_lookup", """
SELECT DISTINCT l_partkey, l_suppkey, max(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey) AS latest FROM lineitem WHERE l_linestatus = 'F'""")
def cached_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_orderkey").alias("latest"))


@query("SO-01_weighted_top", "SELECT p_partkey, round(p_size * 0.45 + p_retailprice * 0.55, 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20 OFFSET 10")
def weighted_top(spark, sf_dir):
    score = F.round(F.col("p_size") * 0.45 + F.col("p_retailprice") * 0.55, 6)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).orderBy(F.col("score").desc(), "p_partkey").offset(10).limit(20)


@query("SO-02_offset_page", "SELECT p_partkey, count(*) OVER () > 20 AS has_more FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 21 OFFSET 40) QUALIFY row_number() OVER (ORDER BY (SELECT NULL)) <= 20")
def offset_page_query(spark, sf_dir):
    page = offset_page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey")], offset=40, limit=20)
    return page.select("p_partkey", "has_more")


@query("SO-07_page_count", "SELECT count(*) AS n_rows, greatest(CAST(ceil(count(*) / 30.0) AS BIGINT), 1) AS n_pages FROM part WHERE p_size > 10")
def page_count_query(spark, sf_dir):
    return page_count(table(spark, sf_dir, "part").where("p_size > 10"), 30)


@query("SO-03_keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50")
def keyset_page_query(spark, sf_dir):
    return keyset_page(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", after=500, limit=50)


@query("SO-08_capped_lists", """
SELECT user_id, event_id, CAST(place AS INTEGER) AS place, greatest(n - 60, 0) AS n_left_out FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE place <= 60""")
def capped_lists_query(spark, sf_dir):
    from palimpsest.operators.ranking import capped_lists

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return capped_lists(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id")], limit=60).drop("ts")


@query("SO-04_nulls_last", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def nulls_last(spark, sf_dir):
    from palimpsest.operators.ranking import global_row_number

    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return global_row_number(docs, [F.col("quality").desc_nulls_last(), F.col("doc_id").asc()], "place")


@query("SO-05_boolean_priority", "SELECT o_orderkey FROM orders ORDER BY (o_orderstatus IN ('P', 'O')) DESC, (o_orderpriority <> '5-LOW'), o_orderdate, o_orderkey LIMIT 100")
def boolean_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderstatus").isin("P", "O").desc(), F.col("o_orderpriority") != "5-LOW", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("SO-06_verdict_then_score", """
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) <= 3""")
def verdict_then_score(spark, sf_dir):
    order = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], [order, F.col("o_totalprice").desc(), F.col("o_orderkey")], keep=3).select("o_custkey", "o_orderkey")


@query("ST-01_union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).union(table(spark, sf_dir, "part").select("p_partkey")).distinct()


@query("ST-02_array_subset", "SELECT l_orderkey, list_has_all(['A', 'N'], list(DISTINCT l_returnflag)) AS inside FROM lineitem GROUP BY l_orderkey")
def array_subset(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return flags.select("l_orderkey", (F.size(F.array_except("f", F.array(F.lit("A"), F.lit("N")))) == 0).alias("inside"))


@query("ST-03_token_jaccard", """
WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS jaccard FROM t""")
def token_jaccard(spark, sf_dir):
    from palimpsest.functions.text import jaccard

    words = lambda c: F.array_distinct(F.split(F.lower(F.col(c)), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(jaccard(words("p_name"), words("p_type")), 6).alias("jaccard"))


@query("ST-04_ordered_dedup", """
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first_at) AS priorities FROM (
  SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) GROUP BY 1""")
def ordered_dedup(spark, sf_dir):
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    rows = firsts.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))).alias("x"))
    return rows.select("o_custkey", F.array_join("x.o_orderpriority", ",").alias("priorities"))
