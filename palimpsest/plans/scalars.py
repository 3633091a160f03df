"""Scalar functions (SC) on strings, dates, numbers, arrays, JSON and hashes."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from palimpsest.functions import dates, edition, text, vectors
from palimpsest.functions.edition import term_code
from palimpsest.functions.json import canonical_json, lenient_json, pointer_set, walk_facts
from palimpsest.plans.joins import GRAMS
from palimpsest.plans.registry import query, table


@query("SC-01_nfkc_lower", "SELECT p_partkey, lower(p_name) AS name FROM part")
def nfkc(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.nfkc_lower("p_name").alias("name"))


@query("SC-02_collapse_space", r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM conversations")
def collapse_space(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.collapse_space(F.col("text"))).alias("collapsed"))


@query("SC-03_normalize_name", "SELECT p_partkey, regexp_replace(replace(replace(lower(p_type), 'promo', ''), 'brushed', ''), '[^0-9a-z가-힣]', '', 'g') AS name FROM part")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_name(F.col("p_type"), ["promo", "brushed"]).alias("name"))


#: Titles of part names in six forms, and the core that each has by construction.
_FORMS = (
    ("'[' || p_brand || '] 2026학년도 1학기 ' || p_name || ' 장학금 선발 안내'", "p || '장학'"),
    ("'’26년 ' || p_name || ' 장학생 2차 모집 (추가)'", "p || '장학'"),
    ("p_brand || ' ' || p_name || ' 장학금 추가모집 신청'", "p || '장학'"),
    ("p_name || ' 67, 68기 [기간연장]'", "p"),
    ("'2024 ' || p_name || ' 하반기 재선발 공고'", "p"),
    ("p_name || ' 26-2학기 대상자 알림'", "p"),
)
_CASE = "CASE p_partkey % 6 {} END".format


@query("SC-04_core_name", f"""
SELECT p_partkey, {_CASE(' '.join(f'WHEN {i} THEN {c}' for i, (_, c) in enumerate(_FORMS)))} AS core_name
FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS p FROM part)""")
def core_name(spark, sf_dir):
    title = F.expr(_CASE(" ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_FORMS))))
    return table(spark, sf_dir, "part").select("p_partkey", edition.core_name(title, F.col("p_brand")).alias("core_name"))


@query("SC-05_edition_tokens", """
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) + 25 AS VARCHAR) AS y, month(o_orderdate) < 7 AS early, o_orderkey % 2 = 0 AS even, day(o_orderdate) AS d, o_custkey % 90 AS c FROM orders)
SELECT o_orderkey, y || CASE WHEN o_orderkey % 3 = 0 AND y <> '2026' THEN ',2026' ELSE '' END AS years, CASE WHEN early THEN 'spring' ELSE 'fall' END || CASE WHEN even THEN ',winter' ELSE '' END AS terms,
  CASE WHEN even THEN '' ELSE 'h2' END AS halves, CAST(d AS VARCHAR) || CASE WHEN even THEN ',additional' ELSE '' END AS rounds, CAST(c + 1 AS VARCHAR) || ',' || CAST(c AS VARCHAR) AS cohorts FROM o""")
def edition_query(spark, sf_dir):
    even, cohort = F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 90
    title = F.concat(
        (F.year("o_orderdate") + 25).cast("string"), F.lit("학년도 "), F.when(F.month("o_orderdate") < 7, "1").otherwise("2"), F.lit("학기 "),
        F.when(F.col("o_orderkey") % 3 == 0, "26년 ").otherwise(""), F.when(even, "동계 ").otherwise("하반기 "),
        F.dayofmonth("o_orderdate").cast("string"), F.lit("차 "), F.when(even, "추가 모집 ").otherwise(""),
        cohort.cast("string"), F.lit(", "), (cohort + 1).cast("string"), F.lit("기"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", edition.edition_tokens(title).alias("e"))
    return found.select("o_orderkey", *[F.array_join(f"e.{k}", ",").alias(k) for k in ("years", "terms", "halves", "rounds", "cohorts")])


@query("SC-06_trigrams", f"SELECT p_partkey, len({GRAMS.format(x='lower(p_name)')}) AS n_grams FROM part")
def trigrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.size(text.trigrams(F.lower("p_name"))).cast("bigint").alias("n_grams"))


@query("SC-07_name_similarity", f"""
WITH x AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), g AS (SELECT *, {GRAMS.format(x='a')} AS ga, {GRAMS.format(x='b')} AS gb FROM x)
SELECT p_partkey, round(CASE WHEN least(length(a), length(b)) = 0 THEN 0.0 WHEN a = b THEN 1.0
  WHEN least(length(a), length(b)) >= 6 AND length(a) <> length(b) AND (contains(a, b) OR contains(b, a)) THEN 0.9
  ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE END, 6) AS similarity FROM g""")
def name_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.name_similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("similarity"))


@query("SC-09_quote_containment", r"""
SELECT d.doc_id, contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) AS compact,
  contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g'))) AS collapsed
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def quote_containment(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    size = F.broadcast(items.agg(F.count("*").alias("size")))  # one row
    docs = table(spark, sf_dir, "documents").crossJoin(size).select("doc_id", F.col("text").alias("block"), (F.col("doc_id") % F.col("size")).alias("item_id"))
    both = docs.join(items.withColumnRenamed("text", "quote"), "item_id")
    b, q = F.col("block"), F.col("quote")
    return both.select("doc_id", text.contains_compact(b, q).alias("compact"), text.contains_collapsed(b, q).alias("collapsed"))


@query("SC-10_quote_offsets", r"""
WITH q AS (SELECT doc_id, regexp_split_to_array(text, '\.\s')[1] AS q FROM documents), t AS (SELECT doc_id, q, trim(regexp_replace(q, '\s+', ' ', 'g')) = '' AS none FROM q)
SELECT doc_id, CASE WHEN NOT none THEN CAST(length(q) - length(regexp_replace(q, '^\s+', '')) AS INTEGER) END AS start,
  CASE WHEN NOT none THEN CAST(length(regexp_replace(q, '\s+$', '')) AS INTEGER) END AS stop FROM t""")
def quote_offsets(spark, sf_dir):
    from palimpsest.operators.packing import small_text_batches

    small_text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quote = F.element_at(F.split("text", r"\.\s"), 1)
    return docs.select("doc_id", text.quote_offsets(F.col("text"), quote).alias("x")).select("doc_id", "x.start", "x.stop")


@query("SC-12_labels", "SELECT c_custkey, left(c_name, 8) || '/' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS label, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'good' END AS state FROM customer")
def labels(spark, sf_dir):
    label = F.concat(F.substring("c_name", 1, 8), F.lit("/"), F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")))
    state = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 1000, "low").otherwise("good")
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), state.alias("state"))


@query("SC-13_amount_label", """
WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 4 AS k FROM orders),
w AS (SELECT *, CASE WHEN v % 10000 = 0 AND v >= 10000 THEN format('{:,}', v // 10000) || '만원' ELSE format('{:,}', v) || '원' END AS won FROM a)
SELECT o_orderkey, CASE k WHEN 0 THEN '50%' WHEN 1 THEN won WHEN 2 THEN '최대 ' || won ELSE won || '~' || won END AS label FROM w""")
def amount_label(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "percentage").when(k == 1, "fixed").when(k == 2, "maximum").otherwise("range")
    v = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.amount_label(kind, v, v, F.lit(50)).alias("label"))


@query("SC-14_lenient_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lenient(spark, sf_dir):
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(lenient_json(broken), "$.k").cast("bigint").alias("k"))


@query("SC-15_strip_nul", "SELECT doc_id, length(replace(text, chr(0), '')) AS n FROM documents")
def strip_nul(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.strip_nul(F.col("text"))).cast("bigint").alias("n"))


@query("SC-16_mask", "SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN left(c_name, 4) || '...' || right(c_name, 4) ELSE '***' END AS masked FROM customer")
def mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_secret(F.col("c_name")).alias("masked"))


@query("SC-17_parse_amount", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders")
def parse_amount(spark, sf_dir):
    written = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit("원"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_amount(written).alias("amount"))


@query("SC-18_url_parts", r"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))


@query("SRC-13_fetch_rules", r"""
SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://(localhost|127\.|10\.|192\.168\.)') AND NOT regexp_matches(url, '^https?://[^/]*@') AND NOT regexp_matches(url, '^https?://[^/]*:[0-9]') AS allowed FROM pages""")
def fetch_rules(spark, sf_dir):
    from palimpsest.sources.store import fetchable

    return table(spark, sf_dir, "pages").select("page_id", fetchable(F.col("url")).alias("allowed"))


#: Bytes put before a page's, as hex, and the format that the file then has.
_WRAPPED = (
    ("", None), ("255044462D", "pdf"), ("504B0304", "binary"), ("504B0304504B0506", "zip"),
    ("504B0304" + "".join("504B0102" + "00" * 42 + n.encode().hex() for n in ("[Content_Types].xml", "word/document.xml")) + "504B0506", "docx"),
    ("504B0304" + "".join("504B0102" + "00" * 42 + n.encode().hex() for n in ("mimetype", "Contents/content.hpf")) + "504B0506", "hwpx"),
    ("D0CF11E0A1B11AE1", "ole"), ("D0CF11E0A1B11AE1" + "".join((n + "\0").encode("utf-16-le").hex() for n in ("FileHeader", "BodyText")), "hwp"),
    ("D0CF11E0A1B11AE1" + "Book\0".encode("utf-16-le").hex(), "xls"),
)


@query("SRC-06_sniff", "SELECT page_id, CASE " + " ".join(f"WHEN page_id % {len(_WRAPPED)} = {i} THEN '{kind}'" for i, (_, kind) in enumerate(_WRAPPED) if kind) + """
  WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'html' ELSE 'binary' END AS format FROM pages""")
def sniff(spark, sf_dir):
    from palimpsest.sources.store import sniff as rule

    before = F.element_at(F.array(*[F.unhex(F.lit(x)) for x, _ in _WRAPPED]), (F.col("page_id") % len(_WRAPPED) + 1).cast("int"))
    content = F.concat(before, F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", rule(content, F.lit(None).cast("string"))["format"].alias("format"))


@query("SRC-05_object_read", """
SELECT page_id, path, CASE WHEN page_id % 3 <> 0 THEN sha256(html) END AS sha FROM (
  SELECT page_id, html, 'sha256/' || substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) AS path FROM pages WHERE html IS NOT NULL)""")
def object_read(spark, sf_dir):
    from palimpsest.sources.store import get

    pages, held = _stored_pages(spark, sf_dir)
    found = get(held, pages.select("path").distinct()).where("found")
    read = found.select(F.col("path").alias("p"), F.sha2("content", 256).alias("read"))
    return pages.join(read, F.col("path") == F.col("p"), "left").select("page_id", "path", F.col("read").alias("sha"))


def _stored_pages(spark, sf_dir):
    """Pages with their store paths, and a store that was given two thirds of them."""
    from palimpsest.operators.lineage import shared_folder
    from palimpsest.sources.store import addressed, put

    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.concat(F.col("html"), F.lit("")).cast("binary").alias("content"))
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    put(pages.where("page_id % 3 <> 0"), folder)
    paths = addressed(pages).select("sha", "path")
    return pages.withColumn("sha", F.sha2("content", 256)).join(paths, "sha"), spark.read.parquet(folder)


@query("DM-30_object_integrity", """
SELECT DISTINCT sha, CASE WHEN page_id % 3 = 0 THEN 'missing' ELSE 'size' END AS problem FROM (SELECT page_id, sha256(html) AS sha, strlen(html) AS n FROM pages WHERE html IS NOT NULL) WHERE page_id % 3 = 0 OR page_id % 7 = 0""")
def object_integrity(spark, sf_dir):
    from palimpsest.sources.store import verify

    pages, held = _stored_pages(spark, sf_dir)
    told = pages.select("sha", (F.octet_length("content") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).alias("size"))
    return verify(held, told).select("sha", "problem")


@query("SC-08_similarity", f"""
WITH x AS (SELECT c_custkey, {GRAMS.format(x='lower(c_mktsegment)')} AS a, {GRAMS.format(x='lower(c_name)')} AS b FROM customer)
SELECT c_custkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS similarity FROM x""")
def similarity(spark, sf_dir):
    score = text.jaccard(text.trigrams(F.lower("c_mktsegment")), text.trigrams(F.lower("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(score, 6).alias("similarity"))


@query("SC-21_application_status", """
WITH w AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 30 AS e, l_returnflag <> 'N' AS rolling FROM lineitem),
f AS (SELECT l_orderkey, bool_or(s <= DATE '1996-06-01' AND NOT e < DATE '1996-06-01') AS active, bool_or(s > DATE '1996-06-01') AS upcoming, bool_and(e < DATE '1996-06-01') AS closed FROM w GROUP BY 1)
SELECT l_orderkey, CASE WHEN active THEN 'active' WHEN upcoming THEN 'upcoming' WHEN closed THEN 'closed' ELSE 'unknown' END AS status FROM f""")
def application_status(spark, sf_dir):
    from palimpsest.operators.records import application_status as rule

    windows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.lit("application").alias("kind"), F.to_date("l_shipdate").alias("start_date"), F.lit(None).cast("int").alias("start_second"),
        F.date_add(F.to_date("l_shipdate"), 30).alias("end_date"), F.lit(None).cast("int").alias("end_second"), F.when(F.col("l_returnflag") != "N", "rolling").otherwise("fixed").alias("closing_rule"))
    return rule(windows, ["l_orderkey"], today="1996-06-01", second=63000)


@query("SC-22_deadline_state", """
SELECT o_orderkey, CASE WHEN d < 0 THEN 'closed' WHEN d = 0 THEN 'D-day' ELSE 'D-' || d END AS label, d BETWEEN 0 AND 7 AS warn
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1996-06-01' AS d FROM orders)""")
def deadline_state(spark, sf_dir):
    label, warn = dates.deadline_state(F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), warn.alias("warn"))


@query("SC-23_month_rest", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def month_rest(spark, sf_dir):
    first, last = dates.month_rest(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.cast("string").alias("first"), last.cast("string").alias("last"))


@query("SC-24_midnight", """
SELECT event_id, strftime(CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END, '%Y-%m-%d') AS day, CASE WHEN event_type = 'view' THEN '00:00' ELSE strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN event_type = 'view' THEN 'minute' ELSE 'second' END AS precision FROM events""")
def midnight(spark, sf_dir):
    written = F.when(F.col("event_type") == "view", "24:00").otherwise(F.date_format("ts", "HH:mm:ss"))
    day, time = dates.next_midnight(F.to_date("ts"), written)
    return table(spark, sf_dir, "events").select("event_id", day.cast("string").alias("day"), time.alias("time"), dates.precision(day, time).alias("precision"))


@query("SC-25_least_gap", """
WITH a AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, CAST(min(abs(a.d - b.d)) AS BIGINT) AS days FROM a JOIN b ON a.o_custkey = b.o_custkey GROUP BY 1""")
def least_gap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    days = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.to_date("o_orderdate")))
    both = orders.groupBy("o_custkey").agg(days("O").alias("a"), days("F").alias("b")).where("size(a) > 0 AND size(b) > 0")
    return both.select("o_custkey", dates.least_gap_days(F.col("a"), F.col("b")).cast("bigint").alias("days"))


@query("SC-26_board_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def board_date(spark, sf_dir):
    written = F.date_format("o_orderdate", "yyyy.MM.dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.board_date(F.when(F.col("o_orderkey") % 3 == 0, F.concat(written, F.lit("."))).otherwise(written)).cast("string").alias("day"))


@query("SC-27_term_code", "SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 3 THEN 'spring' WHEN month(o_orderdate) <= 6 THEN 'summer' WHEN month(o_orderdate) <= 9 THEN 'fall' ELSE 'other' END AS term FROM orders")
def term(spark, sf_dir):
    m = F.month("o_orderdate")
    written = F.when(m <= 3, "1학기").when(m <= 6, "하계 방학").when(m <= 9, "2 학기").otherwise("수시")
    return table(spark, sf_dir, "orders").select("o_orderkey", term_code(written).alias("term"))


@query("SC-28_intervals", "SELECT event_id, ts - INTERVAL 15 MINUTE AS lease, ts + to_seconds(CAST(round(value) AS INTEGER)) AS due FROM events")
def intervals(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("ts") - F.expr("INTERVAL 15 MINUTE")).alias("lease"), (F.col("ts") + F.make_dt_interval(secs=F.round("value").cast("decimal(18,6)"))).alias("due"))


@query("SC-20_clock", """
SELECT event_id, DATE '2024-01-16' - CAST(ts + INTERVAL 9 HOUR AS DATE) AS days_ago, CAST(ts + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-16' AS today,
  ts + INTERVAL 9 HOUR > TIMESTAMP '2024-01-16 00:30:00' AS ahead, 1800 AS second FROM events""")
def clock_query(spark, sf_dir):
    asked = dates.clock(datetime(2024, 1, 15, 15, 30, tzinfo=UTC))
    day = dates.local_day(F.col("ts"))
    ahead = F.convert_timezone(F.lit("UTC"), F.lit(dates.ZONE), "ts") > asked.now
    ago = F.datediff(asked.today, day).cast("long")
    return table(spark, sf_dir, "events").select("event_id", ago.alias("days_ago"), (day == asked.today).alias("today"), ahead.alias("ahead"), asked.second.alias("second"))


@query("SC-30_l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS length
FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    unit = vectors.l2_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(unit, unit), 6).alias("length"))


@query("SC-31_cosine_distance", """
SELECT e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""")
def cosine_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    q = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return rows.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("SC-32_truncate", """
SELECT vec_id, round(list_extract(embedding, 1)::DOUBLE / sqrt(list_dot_product(embedding[1:8]::DOUBLE[], embedding[1:8]::DOUBLE[])), 6) AS first FROM embeddings""")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(vectors.truncate(F.col("embedding"), 8), 1), 6).alias("first"))


@query("SC-34_box_clamp", """
WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0, least(1, l_discount * 12 - 0.2)) AS x0, greatest(0, least(1, l_tax * 15)) AS x1 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x1 > x0 THEN round(x1 - x0, 6) END AS width FROM b""")
def box_clamp(spark, sf_dir):
    from palimpsest.functions.geometry import clamp

    x0, x1 = clamp(F.col("l_discount") * 12 - 0.2), clamp(F.col("l_tax") * 15)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(x1 > x0, F.round(x1 - x0, 6)).alias("width"))


@query("SC-35_box_overlap", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS x0, l_discount + 0.1 AS x1, l_tax AS u0, l_tax + 0.1 AS u1 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(least(x1, u1) - greatest(x0, u0), 0) / (x1 - x0), 6) AS share FROM b""")
def box_overlap(spark, sf_dir):
    from palimpsest.functions.geometry import overlap_share

    d, t = F.col("l_discount"), F.col("l_tax")
    share = overlap_share((d, F.lit(0.0), d + 0.1, F.lit(1.0)), (t, F.lit(0.0), t + 0.1, F.lit(1.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(share, 6).alias("share"))


@query("SC-36_greatest", "SELECT l_orderkey, l_linenumber, greatest(l_tax, l_discount) AS top, round(abs(l_tax - l_discount), 6) AS gap FROM lineitem")
def greatest(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_tax", "l_discount").alias("top"), F.round(F.abs(F.col("l_tax") - F.col("l_discount")), 6).alias("gap"))


@query("SC-40_array_functions", """
SELECT o_custkey, len(k) AS n, array_to_string(list_sort(list_append(list_concat(k, ['x']), 'y')), '|') AS joined FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1)""")
def array_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("k"))
    more = F.array_append(F.concat("k", F.array(F.lit("x"))), "y")
    return rows.select("o_custkey", F.size("k").cast("bigint").alias("n"), F.array_join(F.array_sort(more), "|").alias("joined"))


@query("SC-41_json_array_length", """SELECT event_id, CAST(json_array_length('[' || json_extract_string(props, '$.k') || ',1]') AS BIGINT) AS n FROM events""")
def json_array_length(spark, sf_dir):
    listed = F.concat(F.lit('{"k":['), F.get_json_object("props", "$.k"), F.lit(",1]}"))
    return table(spark, sf_dir, "events").select("event_id", F.json_array_length(F.get_json_object(listed, "$.k")).cast("bigint").alias("n"))


@query("SC-42_json_merge", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS merged FROM events""")
def json_merge(spark, sf_dir):
    merged = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").select("event_id", merged.alias("merged"))


@query("SC-43_json_counter", "SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS metrics FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def json_counter(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.concat(F.lit('"'), "event_type", F.lit('":'), F.col("n").cast("string"))))
    return n.groupBy("user_id").agg(F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}")).alias("metrics"))


@query("SC-44_pointer_set", """SELECT event_id, '{"k": "' || event_type || '"}' AS props FROM events""")
def pointer(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", pointer_set(F.col("props"), F.lit("/k"), F.col("event_type")).alias("props"))


@query("SC-45_fact_walk", "SELECT o_orderkey, '/amount' AS path, CASE WHEN o_orderstatus = 'F' THEN 'conflict' ELSE 'stated' END AS state FROM orders")
def fact_walk(spark, sf_dir):
    fact = F.to_json(F.struct(F.struct(F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", "conflict").otherwise("stated").alias("state")).alias("amount")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(walk_facts(fact)).alias("f"))
    return rows.select("o_orderkey", "f.path", "f.state")


@query("SC-46_canonical_json", """SELECT event_id, '{"a":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def canonical(spark, sf_dir):
    loose = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": "'), "event_type", F.lit('" }'))
    return table(spark, sf_dir, "events").select("event_id", canonical_json(loose).alias("canonical"))


@query("SC-47_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SC-50_block_ids", "SELECT l_orderkey, l_linenumber, sha256(l_orderkey || '|' || format('line:{:06d}', l_linenumber)) AS block_id FROM lineitem")
def block_ids(spark, sf_dir):
    from palimpsest.operators.blocks import stable_key

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), stable_key("line", F.col("l_linenumber"))), 256).alias("block_id"))


@query("SC-51_line_diff")
def line_diff(spark, sf_dir):
    from palimpsest.functions.diff import unified
    from palimpsest.operators.compare import predecessor

    rows = predecessor(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["text"])
    return rows.where("prev_text IS NOT NULL").select("conv_id", "turn", F.md5(unified(F.col("prev_text"), F.col("text"))).alias("diff_md5"))
