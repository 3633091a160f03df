"""Domain operators (DM): identity, resolution, assembly, review and integrity."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import identity, integrity, records, resolution
from palimpsest.operators.latest import effective_overrides
from palimpsest.plans.joins import CANDIDATES, GRAMS, candidates
from palimpsest.plans.registry import query, table


def _strings(*values):
    return F.array(*values).cast("array<string>") if values else F.array().cast("array<string>")


def _signature(prefix, year, rounds, day):
    none = _strings()
    return F.struct(
        _strings(year).alias("fact_years"), none.alias("name_years"), none.alias("fact_terms"), none.alias("name_terms"), none.alias("halves"),
        rounds.alias("rounds"), none.alias("cohorts"), F.array(day).alias("deadlines"), F.array().cast("array<date>").alias("starts")).alias(prefix)


@query("DM-01_edition_verdict", """
WITH p AS (SELECT a.o_orderkey AS l, b.o_orderkey AS r, (a.o_orderkey * 7 + b.o_orderkey) % 100 / 100.0::DOUBLE AS score, year(a.o_orderdate) AS ly, year(b.o_orderdate) AS ry,
  a.o_orderpriority = '1-URGENT' AS lr, b.o_orderpriority = '1-URGENT' AS rr, abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) AS gap
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT l, r, CASE WHEN score < 0.55 THEN 'different' WHEN ly <> ry OR gap > 150 THEN 'different_edition' WHEN lr <> rr THEN 'uncertain' WHEN score >= 0.82 THEN 'same' ELSE 'uncertain' END AS verdict FROM p""")
def edition_verdict(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    none = _strings()
    rounds = F.when(F.col("o_orderpriority") == "1-URGENT", _strings(F.lit("1"))).otherwise(none)
    side = lambda p: orders.select("o_custkey", F.col("o_orderkey").alias(f"{p}k"), _signature(p, F.year("o_orderdate"), rounds, F.to_date("o_orderdate")))
    pairs = side("left").join(side("right"), "o_custkey").where("leftk < rightk")
    score = (F.col("leftk") * 7 + F.col("rightk")) % 100 / F.lit(100.0)
    return pairs.select(F.col("leftk").alias("l"), F.col("rightk").alias("r"), identity.verdict(score, "left", "right").alias("verdict"))


@query("DM-02_signatures", """
WITH l AS (SELECT l_orderkey, string_agg(DISTINCT strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY strftime(l_shipdate, '%Y-%m-%d')) AS deadlines FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1)
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS fact_years, CAST(year(o_orderdate) + 25 AS VARCHAR) AS name_years, CASE WHEN o_orderkey % 2 = 0 THEN 'spring' ELSE 'summer' END AS name_terms,
  CAST(1 + o_custkey % 9 AS VARCHAR) AS rounds, coalesce(deadlines, '') AS deadlines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def signatures(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.to_date("l_shipdate"))).alias("days"))
    title = F.concat((F.year("o_orderdate") + 25).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "학년도 1학기 제").otherwise("년 하계 제"), (1 + F.col("o_custkey") % 9).cast("string"), F.lit("차 장학생"))
    rows = table(spark, sf_dir, "orders").join(days, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    found = rows.select("o_orderkey", identity.signature(title, fact_years=_strings(F.year("o_orderdate")), deadlines=F.col("days")).alias("s"))
    dates = F.array_join(F.transform("s.deadlines", lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("deadlines")
    return found.select("o_orderkey", *[F.array_join(f"s.{k}", ",").alias(k) for k in ("fact_years", "name_years", "name_terms", "rounds")], dates)


@query("DM-03_proposals", f"""
WITH p AS (SELECT subject, candidate, similarity, floor(a.p_retailprice)::BIGINT % 4 AS ly, floor(b.p_retailprice)::BIGINT % 4 AS ry FROM ({CANDIDATES}) JOIN part a ON a.p_partkey = subject JOIN part b ON b.p_partkey = candidate),
v AS (SELECT *, CASE WHEN similarity < 0.55 THEN 'different' WHEN ly <> ry THEN 'different_edition' WHEN similarity >= 0.82 THEN 'same' ELSE 'uncertain' END AS verdict FROM p)
SELECT subject, candidate, verdict FROM v WHERE verdict IN ('same', 'uncertain') QUALIFY row_number() OVER (PARTITION BY subject ORDER BY CASE verdict WHEN 'same' THEN 0 ELSE 1 END, similarity DESC, candidate) <= 3""")
def proposals(spark, sf_dir):
    year = (F.floor("p_retailprice") % 4).cast("string")
    side = lambda key, p: table(spark, sf_dir, "part").select(F.col("p_partkey").alias(key), _signature(p, year, _strings(), F.lit(None).cast("date")))
    pairs = candidates(spark, sf_dir).join(side("subject", "left"), "subject").join(side("candidate", "right"), "candidate")
    ruled = pairs.select("subject", "candidate", F.col("similarity").alias("score"), identity.verdict(F.col("similarity"), "left", "right").alias("verdict"))
    return identity.proposals(ruled, subject="subject", candidate="candidate").select("subject", "candidate", "verdict")


#: Orders as names of items and records: most words are unlike, two contain one another, one is near a third.
_WORDS = {"1-URGENT": "harbourgrant", "2-HIGH": "harbourgrants", "3-MEDIUM": "forestaward", "4-NOT SPECIFIED": "forestawards", "5-LOW": "harborgrants"}
_NAMES = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items()) + " END"


@query("DM-04_match_items", f"""
WITH RECURSIVE o AS (
  SELECT o_custkey * 20 + month(o_orderdate) AS notice, o_orderkey AS k, o_orderstatus AS st, {_NAMES} AS name, CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) % 2 END AS y,
    o_orderkey % 11 = 0 AS rd, 1 + o_orderkey % 5 // 4 AS previous FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY notice ORDER BY k) AS n, count(*) OVER (PARTITION BY notice) AS items FROM o WHERE st = 'O'),
r AS (SELECT *, count(*) OVER (PARTITION BY notice) AS records FROM o WHERE st = 'F'),
words AS (SELECT name, {GRAMS.format(x='name')} AS g FROM (SELECT DISTINCT name FROM o)),
g AS (SELECT i.notice, i.n, r.k AS record, r.previous, records, i.y AS iy, r.y AS ry, i.rd AS ir, r.rd AS rr,
  CASE WHEN i.name = r.name THEN 1.0 WHEN length(i.name) <> length(r.name) AND (contains(i.name, r.name) OR contains(r.name, i.name)) THEN 0.9
    ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE END AS score
  FROM i JOIN r USING (notice) JOIN words a ON a.name = i.name JOIN words b ON b.name = r.name),
v AS (SELECT notice, n, list({{'record': record, 'previous': previous, 'records': records, 'verdict': CASE WHEN score < 0.55 THEN 'different' WHEN iy <> ry THEN 'different_edition' WHEN ir <> rr THEN 'uncertain'
  WHEN score >= 0.82 AND iy = ry THEN 'same' ELSE 'uncertain' END}}) AS found FROM g GROUP BY 1, 2),
f AS (SELECT i.notice, i.n, i.k AS pos, i.items, coalesce(found, []) AS found FROM i LEFT JOIN v USING (notice, n)),
w AS (
  SELECT notice, 0 AS n, NULL::BIGINT AS pos, []::BIGINT[] AS taken, NULL::BIGINT AS record, NULL::VARCHAR AS how FROM (SELECT DISTINCT notice FROM i)
  UNION ALL
  SELECT notice, n, pos, CASE WHEN how IS NULL THEN taken ELSE list_append(taken, record) END, record, how FROM (
    SELECT *, CASE WHEN len(same) = 1 THEN same[1].record WHEN slot THEN found[1].record END AS record,
      CASE WHEN len(same) = 1 THEN 'same' WHEN slot THEN CASE WHEN found[1].verdict = 'different' THEN 'renamed' ELSE 'slot' END END AS how
    FROM (SELECT *, coalesce(len(same) = 0 AND items = 1 AND len(found) = 1 AND NOT list_contains(taken, found[1].record) AND found[1].verdict <> 'different_edition' AND found[1].previous = 1, false) AS slot
      FROM (SELECT f.notice, f.n, f.pos, f.items, f.found, w.taken, list_filter(f.found, lambda x: x.verdict = 'same' AND NOT list_contains(w.taken, x.record)) AS same FROM w JOIN f ON f.notice = w.notice AND f.n = w.n + 1))))
SELECT notice, pos, record, how FROM w WHERE n > 0""")
def match_items(spark, sf_dir):
    year = F.when(F.col("o_orderkey") % 3 > 0, _strings(F.year("o_orderdate") % 2)).otherwise(_strings())
    rounds = F.when(F.col("o_orderkey") % 11 == 0, _strings(F.lit("1"))).otherwise(_strings())
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 20 + F.month("o_orderdate")).alias("notice"), "o_orderkey", "o_orderstatus", F.expr(_NAMES).alias("name"), _signature("mark", F.lit(""), rounds, F.lit(None).cast("date")),
        year.alias("year"), (1 + F.floor(F.col("o_orderkey") % 5 / 4)).alias("previous"))
    orders = orders.withColumn("mark", F.col("mark").withField("fact_years", F.col("year")).withField("deadlines", F.array().cast("array<date>")))
    records_ = orders.where("o_orderstatus = 'F'").withColumn("record", F.col("o_orderkey"))
    items = orders.where("o_orderstatus = 'O'").withColumn("pos", F.col("o_orderkey"))
    return identity.match_items(items, records_)


@query("DM-05_version_rows", """
SELECT l_orderkey, coalesce(max(l_quantity) FILTER (WHERE l_returnflag = 'A'), max(l_quantity) FILTER (WHERE l_returnflag = 'N')) AS capacity, count(*) AS n_windows FROM lineitem GROUP BY l_orderkey""")
def version_rows(spark, sf_dir):
    best = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(best("A"), best("N")).alias("capacity"), F.count("*").alias("n_windows"))


@query("DM-05_assembled_versions", """
WITH d AS (SELECT DISTINCT o_custkey AS record, o_orderkey AS pos, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS name, o_orderkey % 5 = 0 AS warned, o_orderkey % 11 = 0 AS conflict,
    CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'complete' END AS coverage, o_orderkey % 3 = 0 AS unsure, s.n AS selected, m.n AS nominated, o_orderpriority AS p FROM orders
  LEFT JOIN (SELECT l_orderkey, max(CAST(l_quantity AS BIGINT)) - 25 AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) s ON s.l_orderkey = o_orderkey
  LEFT JOIN (SELECT l_orderkey, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) m ON m.l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'),
v AS (SELECT o_custkey AS record, count(*) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT d.*, coalesce(last, 0) + row_number() OVER (PARTITION BY d.record ORDER BY pos) - 1 AS prev FROM d LEFT JOIN v USING (record)),
q AS (SELECT *, CASE WHEN warned OR conflict OR coverage <> 'complete' THEN 'needs_review' WHEN unsure THEN 'partial' ELSE 'complete' END AS quality FROM n)
SELECT record, pos, prev + 1 AS version_no, nullif(prev, 0) AS supersedes, CASE WHEN prev = 0 THEN 'initial' ELSE 'in_place_edit' END AS edit_kind, coalesce(name, '제목 확인 필요') AS title, quality,
  array_to_string(list_filter([CASE WHEN warned THEN 'w' END, CASE WHEN conflict THEN 'field_conflict' END, CASE WHEN quality = 'partial' THEN 'asset_collection_incomplete' END], lambda x: x IS NOT NULL), ',') AS quality_flags,
  CASE WHEN coalesce(selected, nominated) >= 0 THEN coalesce(selected, nominated) END AS capacity, CASE WHEN selected IS NOT NULL THEN 'final_selection' WHEN nominated IS NOT NULL THEN 'university_nomination' END AS capacity_scope,
  'a; ' || p AS support_summary, CASE WHEN pos % 2 = 0 THEN p || chr(10) || 'b' END AS eligibility_summary FROM q""")
def assembled_versions(spark, sf_dir):
    orders, x = table(spark, sf_dir, "orders"), F.col
    most = lambda flag, name: table(spark, sf_dir, "lineitem").where(x("l_returnflag") == flag).groupBy(x("l_orderkey").alias("o_orderkey")).agg(F.max(x("l_quantity").cast("long")).alias(name))
    drafts = orders.where("o_orderstatus <> 'F'").join(most("A", "selected"), "o_orderkey", "left").join(most("N", "nominated"), "o_orderkey", "left")
    some = lambda when, *values: F.when(when, _strings(*map(F.lit, values))).otherwise(_strings())
    drafts = drafts.select(
        x("o_custkey").alias("record"), x("o_orderkey").alias("pos"), F.when(x("o_orderkey") % 7 > 0, x("o_orderpriority")).alias("name"), some(x("o_orderkey") % 5 == 0, "w").alias("warnings"),
        (x("o_orderkey") % 11 == 0).alias("conflict"), F.when(x("o_orderstatus") == "P", "partial").otherwise("complete").alias("coverage"), some(x("o_orderkey") % 3 == 0, "asset_collection_incomplete").alias("provenance"),
        (x("selected") - 25).alias("selected"), "nominated", _strings(F.lit("a"), F.lit(None), x("o_orderpriority")).alias("benefits"),
        F.when(x("o_orderkey") % 2 == 0, _strings(x("o_orderpriority"), F.lit(""), F.lit("b"))).otherwise(_strings()).alias("conditions"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    versions = orders.where("o_orderstatus = 'F'").select(x("o_custkey").alias("record"), place.alias("version_no"))
    return records.assemble_versions(drafts, versions).withColumn("quality_flags", F.array_join("quality_flags", ","))


@query("DM-06_quality_ladder", """
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 48) > 0 OR bool_or(l_returnflag = 'R') THEN 'needs_review' WHEN bool_or(l_linestatus = 'O') THEN 'partial' ELSE 'complete' END AS quality FROM lineitem GROUP BY l_orderkey""")
def quality_ladder(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_quantity") > 48).alias("w"), F.bool_or(F.col("l_returnflag") == "R").alias("c"), F.bool_or(F.col("l_linestatus") == "O").alias("p"))
    return flags.select("l_orderkey", records.quality(F.col("w"), F.col("c"), F.lit("complete"), F.col("p")).alias("quality"))


@query("DM-07_window_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'conflicting' WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'unknown' END AS confirmation,
  CASE WHEN l_returnflag = 'A' THEN 'rolling' WHEN l_linestatus = 'F' THEN 'fixed' ELSE 'unknown' END AS closing FROM lineitem""")
def window_rows(spark, sf_dir):
    end = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))
    state = F.when(F.col("l_returnflag") == "R", "conflict").otherwise("stated")
    stated = F.when(F.col("l_returnflag") == "A", "rolling").otherwise("fixed")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", records.confirmation(state, end).alias("confirmation"), records.closing_rule(stated, end).alias("closing"))


@query("DM-08_benefit_rows", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS lo, CASE WHEN l_linestatus = 'O' THEN 25.0 END AS hi, CASE WHEN l_tax > 0.04 THEN l_tax END AS pct FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo = hi THEN 'fixed' ELSE 'range' END WHEN hi IS NOT NULL THEN 'maximum' WHEN pct IS NOT NULL THEN 'percentage' ELSE 'unknown' END AS shape FROM b""")
def benefit_rows(spark, sf_dir):
    low, high, percent = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")), F.when(F.col("l_linestatus") == "O", F.lit(25.0)), F.when(F.col("l_tax") > 0.04, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", records.benefit_shape(low, high, percent).alias("shape"))


@query("DM-09_dimension_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'unrestricted' WHEN 'F' THEN 'restricted' ELSE 'unknown' END AS status FROM orders")
def dimension_status(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "explicitly_none").when(F.col("o_orderstatus") == "F", "stated").otherwise("not_found")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.dimension_status(state).alias("status"))


@query("DM-10_evidence_rows", "SELECT event_id, '/amount' AS path, CASE WHEN value < 10 THEN 'conflicting' ELSE 'candidate' END AS status, event_type AS quote FROM events")
def evidence_rows(spark, sf_dir):
    from palimpsest.functions.json import walk_facts

    evidence = F.array(F.struct(F.col("event_type").alias("quote")))
    fact = F.to_json(F.struct(F.struct(F.col("value").alias("value"), F.when(F.col("value") < 10, "conflict").otherwise("stated").alias("state"), evidence.alias("evidence")).alias("amount")))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(walk_facts(fact)).alias("f"))
    return rows.select("event_id", "f.path", F.when(F.col("f.state") == "conflict", "conflicting").otherwise("candidate").alias("status"), F.element_at("f.quotes", 1).alias("quote"))


#: Orders as extracted trees: a fact, and for each line a fact within a window, an object with evidence, and one without.
_TREE_ROWS = """
WITH l AS (SELECT l_orderkey, n - 1 AS i, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))),
r AS (
  SELECT o_orderkey, '/name' AS path, 0 AS pos, 's' || o_custkey % 20 AS block_id, o_orderpriority AS quote, CASE WHEN o_orderkey % 4 = 0 THEN 'inferred' ELSE 'direct' END AS kind,
    '"' || o_orderpriority || '"' AS value, CASE WHEN o_orderstatus = 'F' THEN 'conflict' ELSE 'stated' END AS state FROM orders
  UNION ALL SELECT l_orderkey, '/windows/' || i || '/end', 0, 's' || l_suppkey, 'q' || l_partkey, 'direct', '' || l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'conflict' ELSE 'stated' END FROM l JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_orderkey, '/windows/' || i || '/end', 1, 's' || (l_suppkey + 1), 'second', 'inferred', '' || l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'conflict' ELSE 'stated' END FROM l JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_orderkey, '/windows/' || i || '/benefit', 0, 's' || l_suppkey, 'benefit', 'direct', '{"kind": "line"}', 'stated' FROM l JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, s_nationkey AS document, r.block_id, path, value, quote, kind,
  CASE WHEN state = 'conflict' THEN 'conflicting' WHEN pending THEN 'candidate' ELSE 'accepted' END AS status, CASE WHEN pending THEN 'pending' ELSE 'verified' END AS verification
FROM (SELECT *, kind = 'inferred' OR (path = '/windows/1/end' AND pos = 0) AS pending FROM r) r JOIN (SELECT 's' || s_suppkey AS block_id, s_nationkey FROM supplier WHERE s_acctbal > 0) USING (block_id)"""


@query("DM-10_evidence_tree", _TREE_ROWS)
def evidence_tree(spark, sf_dir):
    from palimpsest.operators.evidence import evidence_rows as rows_of

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    ref = lambda block, quote, kind: F.struct(block.alias("block_id"), quote.alias("quote"), kind.alias("evidence_type"))
    direct, x = F.lit("direct"), F.col
    stated = lambda w: F.when(w["l_partkey"] % 7 == 0, "conflict").otherwise("stated")
    end = lambda w: F.struct(w["l_partkey"].alias("value"), stated(w).alias("state"), F.array(ref(text("s", w["l_suppkey"]), text("q", w["l_partkey"]), direct), ref(text("s", w["l_suppkey"] + 1), F.lit("second"), F.lit("inferred"))).alias("evidence"))
    benefit = lambda w: F.struct(F.lit("line").alias("kind"), F.array(ref(text("s", w["l_suppkey"]), F.lit("benefit"), direct)).alias("evidence"))
    windows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("w"))
    rule = F.struct(F.struct(F.lit("unknown").alias("state")).alias("deep")).alias("rule")
    kept = F.transform("w", lambda w: F.struct(end(w).alias("end"), benefit(w).alias("benefit"), rule))
    kind = F.when(x("o_orderkey") % 4 == 0, "inferred").otherwise("direct")
    name = F.struct(x("o_orderpriority").alias("value"), F.when(x("o_orderstatus") == "F", "conflict").otherwise("stated").alias("state"), F.array(ref(text("s", x("o_custkey") % 20), x("o_orderpriority"), kind)).alias("evidence"))
    orders = table(spark, sf_dir, "orders").join(windows, x("l_orderkey") == x("o_orderkey"), "left")
    trees = orders.select("o_orderkey", F.to_json(F.struct(name.alias("name"), kept.alias("windows"))).alias("tree"))
    blocks = orders.select("o_orderkey", F.explode(F.array_distinct(F.concat(F.array(x("o_custkey") % 20), F.flatten(F.transform(F.coalesce("w", F.array()), lambda w: F.array(w["l_suppkey"], w["l_suppkey"] + 1)))))).alias("s"))
    blocks = blocks.join(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), x("s") == x("s_suppkey")).select("o_orderkey", text("s", x("s")).alias("block_id"), x("s_nationkey").alias("document"))
    warned = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("/windows/1/end/evidence/0: the quote isn't there").alias("warning"))
    return rows_of(trees, blocks, warned, key="o_orderkey", tree="tree")


@query("DM-11_evidence_validation", r"""
SELECT d.doc_id, contains(regexp_replace(text, '\s+', '', 'g'), regexp_replace(split_part(text, '.', 1), '\s+', '', 'g')) AS valid FROM documents d""")
def evidence_validation(spark, sf_dir):
    from palimpsest.functions.text import contains_compact

    return table(spark, sf_dir, "documents").select("doc_id", contains_compact(F.col("text"), F.split_part("text", F.lit("."), F.lit(1))).alias("valid"))


@query("DM-12_fact_values", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS value FROM orders")
def fact_values(spark, sf_dir):
    fact = F.struct(F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "O", "stated").otherwise("unknown").alias("state"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fact.alias("f")).select("o_orderkey", records.fact_value(F.col("f")).alias("value"))


@query("DM-13_placeholder_headcount", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 3 THEN CAST(l_linenumber AS INTEGER) END AS digits FROM lineitem")
def placeholder_headcount(spark, sf_dir):
    written = F.when(F.col("l_linenumber") <= 3, F.concat(F.repeat(F.lit("0"), F.col("l_linenumber")), F.lit("명"))).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("0명")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", records.headcount_digits(written).alias("digits"))


@query("DM-14_title_revision", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'cancellation' WHEN '2-HIGH' THEN 'extension' WHEN '3-MEDIUM' THEN 'correction' WHEN '5-LOW' THEN 'repost' END AS kind FROM orders")
def title_revision(spark, sf_dir):
    words = {"1-URGENT": "[취소] 공고 연장", "2-HIGH": "[기간연장]", "3-MEDIUM": "(정정) 변경", "5-LOW": "[재게시]"}
    title = F.lit("장학생 모집")
    for k, v in words.items():
        title = F.when(F.col("o_orderpriority") == k, v).otherwise(title)
    return table(spark, sf_dir, "orders").select("o_orderkey", records.title_revision(title).alias("kind"))


_DM15 = """
WITH c AS (SELECT l_orderkey, l_returnflag AS key, CAST(min(l_partkey) % 3 AS VARCHAR) AS value FROM lineitem GROUP BY 1, 2),
l AS (SELECT * FROM c a WHERE NOT (key <> 'R' AND EXISTS (SELECT 1 FROM c b WHERE b.l_orderkey = a.l_orderkey AND b.key = 'R'))),
r AS (SELECT l_orderkey, count(DISTINCT value) AS v, min(key) AS k, count(*) AS n FROM l GROUP BY 1), t AS (SELECT l_orderkey, count(*) AS n FROM c GROUP BY 1)
SELECT t.l_orderkey, CASE WHEN v <> 1 THEN 'unresolved' WHEN r.n < t.n THEN 'resolved_explicit_update' ELSE 'agreed' END AS outcome, CASE WHEN v = 1 THEN k END AS selected FROM t JOIN r USING (l_orderkey)"""


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("key")).agg((F.min("l_partkey") % 3).cast("string").alias("value"))


@query("DM-15_resolution_by_joins", _DM15)
def resolution_by_joins(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    newer = F.bool_or(F.col("key") == "R").over(Window.partitionBy("l_orderkey"))
    superseded = c.withColumn("newer", newer).where("newer AND key <> 'R'")
    return resolution.resolve_acyclic(c, superseded, ["l_orderkey"])


def _directives(c):
    others = c.where("key <> 'R'").groupBy("l_orderkey").agg(F.collect_set("key").alias("superseded"))
    return c.where("key = 'R'").join(others, "l_orderkey").select("l_orderkey", F.lit("d1").alias("key"), F.lit("R").alias("selected"), "superseded", F.lit(True).alias("verified"))


@query("DM-15_resolution_grouped", _DM15)
def resolution_grouped(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return resolution.resolve_fields(c, _directives(c), ["l_orderkey"])


@query("DM-15_pending_amendments", f"""
SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unresolved' ELSE coalesce(outcome, 'not_stated') END AS outcome, CASE WHEN o_orderpriority <> '1-URGENT' THEN selected END AS selected
FROM orders LEFT JOIN ({_DM15}) x ON x.l_orderkey = o_orderkey WHERE x.l_orderkey IS NOT NULL OR o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def pending_amendments(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    pending = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit("p1").alias("key"), (F.col("o_orderpriority") == "1-URGENT").alias("verified"))
    return resolution.resolve_fields(c, _directives(c), ["l_orderkey"], pending)


@query("DM-17_window_paths", """
SELECT l_orderkey, '/application_windows/' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS path, l_linenumber || ':' || l_partkey AS window_key FROM lineitem""")
def window_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("w"))
    each = rows.select("l_orderkey", F.posexplode("w").alias("pos", "x"))
    return each.select("l_orderkey", F.concat(F.lit("/application_windows/"), F.col("pos").cast("string")).alias("path"), F.concat_ws(":", F.col("x.l_linenumber").cast("string"), F.col("x.l_partkey").cast("string")).alias("window_key"))


@query("DM-18_effective_overrides", """
SELECT user_id, event_id FROM (SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC) WHERE event_type <> 'view'""")
def effective(spark, sf_dir):
    commands = table(spark, sf_dir, "events").withColumn("action", F.when(F.col("event_type") == "view", "remove").otherwise("set"))
    return effective_overrides(commands, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("DM-19_redirect_chains", """
WITH RECURSIVE r(k, t) AS (SELECT p_partkey, p_partkey - p_size FROM part WHERE p_partkey % 10 = 0 AND p_partkey - p_size > 0),
c(k, t, d) AS (SELECT k, t, 0 FROM r UNION ALL SELECT c.k, r.t, d + 1 FROM c JOIN r ON r.k = c.t)
SELECT k, arg_max(t, d) AS final FROM c GROUP BY k""")
def redirect_chains(spark, sf_dir):
    redirects = table(spark, sf_dir, "part").where("p_partkey % 10 = 0 AND p_partkey - p_size > 0").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") - F.col("p_size")).alias("t"))
    return identity.follow_redirects(redirects, source="k", target="t")


@query("DM-20_winner", """
SELECT a.o_orderkey AS l, b.o_orderkey AS r, CASE WHEN (a.o_orderstatus <> 'F', a.o_orderdate, a.o_orderkey) < (b.o_orderstatus <> 'F', b.o_orderdate, b.o_orderkey) THEN a.o_orderkey ELSE b.o_orderkey END AS winner
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey""")
def winner(spark, sf_dir):
    side = lambda p: table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", (F.col("o_orderstatus") == "F").alias("published"), "o_orderdate").alias(p))
    pairs = side("x").join(side("y"), "o_custkey").where("x.o_orderkey < y.o_orderkey")
    return pairs.select(F.col("x.o_orderkey").alias("l"), F.col("y.o_orderkey").alias("r"), identity.winner("x", "y", published="published", created="o_orderdate", key="o_orderkey").alias("winner"))


@query("DM-21_in_force", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id NOT IN (SELECT event_id - 3 FROM events WHERE event_id % 7 = 0)")
def in_force(spark, sf_dir):
    decisions = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id") - 3).alias("reverses"))
    return identity.in_force(decisions, key="event_id").select("event_id")


@query("DM-22_split_item", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 2")
def split_item(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("w"))
    return rows.select("l_orderkey", F.posexplode("w").alias("pos", "x")).where("pos = 1").select("l_orderkey", "x.l_linenumber", "x.l_partkey")


@query("DM-23_proposal_state", """
SELECT p.event_id, coalesce(c.event_type, 'open') AS state FROM events p LEFT JOIN events c ON c.event_id = p.event_id + 5 AND c.event_id % 2 = 1 WHERE p.event_id % 2 = 0""")
def proposal_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    closing = events.where("event_id % 2 = 1").select((F.col("event_id") - 5).alias("supersedes"), "event_type")
    open_ = events.where("event_id % 2 = 0").select("event_id")
    return open_.join(closing, F.col("event_id") == F.col("supersedes"), "left").select("event_id", F.coalesce("event_type", F.lit("open")).alias("state"))


@query("DM-25_quality_clearing", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'needs_review' WHEN bool_or(l_linestatus = 'O') THEN 'partial' ELSE 'complete' END AS quality FROM lineitem GROUP BY l_orderkey")
def quality_clearing(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("c"), F.bool_or(F.col("l_linestatus") == "O").alias("p"))
    return f.select("l_orderkey", records.cleared_quality(F.col("c"), F.col("p")).alias("quality"))


@query("DM-26_publishable", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 5) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def publishable(spark, sf_dir):
    drafts, lines = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "lineitem")
    has = drafts.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(lines.where("l_quantity < 5"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return has.join(table(spark, sf_dir, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("DM-27_violations", """
SELECT 'order without customer' AS rule, CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'discount over 9%', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE NOT l_discount <= 0.09
UNION ALL SELECT 'two lines of one number', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order without lines', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'negative balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE NOT c_acctbal >= 0""")
def violations(spark, sf_dir):
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return integrity.report({
        "order without customer": (integrity.orphans(orders, customers, "o_custkey", "c_custkey"), "o_orderkey"),
        "discount over 9%": (integrity.broken(lines, F.col("l_discount") <= 0.09), "l_orderkey"),
        "two lines of one number": (integrity.not_unique(lines, ["l_orderkey", "l_linenumber"]), "l_orderkey"),
        "order without lines": (integrity.orphans(orders, lines, "o_orderkey", "l_orderkey"), "o_orderkey"),
        "negative balance": (integrity.broken(customers, F.col("c_acctbal") >= 0), "c_custkey"),
    })


#: The tables of a publication, read from orders, line items, parts and suppliers; the same SQL runs in Spark and in DuckDB.
_PUBLICATION = {
    "versions": "SELECT o_orderkey AS id, o_custkey AS opportunity, CASE o_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'needs_review' ELSE 'partial' END AS quality FROM orders WHERE o_orderstatus = 'F'",
    "sources": """SELECT l_orderkey AS version, l_partkey AS notice_version, CASE WHEN l_quantity > 2 THEN 'confirmed' ELSE 'proposed' END AS relationship, l_linenumber <= 2 AS current,
      CASE WHEN l_linenumber = 1 THEN l_suppkey END AS decision, CASE WHEN l_returnflag = 'R' THEN 'correction' ELSE 'original' END AS relation, l_suppkey AS run FROM lineitem WHERE l_orderkey % 11 <> 0""",
    "notice_versions": "SELECT p_partkey AS id, p_partkey % 50 AS notice, p_size > 1 AS sealed, CASE WHEN p_size > 5 THEN 'complete' ELSE 'partial' END AS assets FROM part",
    "runs": "SELECT s_suppkey AS id, s_acctbal > -500 AS sealed, CASE WHEN s_nationkey <> 3 THEN 'succeeded' ELSE 'failed' END AS status FROM supplier",
    "resolutions": """SELECT o_orderkey AS id, o_orderkey AS version, CASE o_orderkey % 5 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved_explicit_update' ELSE 'agreed' END AS status,
      o_orderkey * 10 + 1 AS selected_evidence, o_orderkey % 7 AS selected_value, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 10 + 12 WHEN o_orderkey % 4 = 1 THEN o_orderkey * 10 + 2 END AS intent_evidence,
      CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey * 10 + 3 END AS cross_evidence FROM orders""",
    "evidence": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS version, CASE WHEN l_linenumber < 5 THEN l_orderkey END AS resolution, l_quantity > 3 AS verified,
      CASE l_returnflag WHEN 'R' THEN 'superseded' WHEN 'A' THEN 'accepted' ELSE 'conflicting' END AS candidate, l_orderkey % 7 + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS value, l_suppkey AS document FROM lineitem""",
    "decisions": "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN 'confirmed' ELSE 'proposed' END AS status, s_suppkey % 100 AS opportunity, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 70 END AS other FROM supplier",
    "documents": "SELECT s_suppkey AS id, s_acctbal > -800 AS sealed, CASE WHEN s_nationkey = 3 THEN 'failed' WHEN s_nationkey = 4 THEN 'partial' ELSE 'succeeded' END AS status FROM supplier",
    "chunks": "SELECT l_orderkey AS version, l_suppkey AS document FROM lineitem WHERE l_linenumber = 1",
}
#: The same joins in SQL, and what of them breaks each rule.
_JOINED = {
    "mapped": "SELECT s.*, n.sealed AS n_sealed, n.notice, n.assets, x.sealed AND x.status = 'succeeded' AS extracted FROM sources s, notice_versions n, runs x WHERE n.id = s.notice_version AND x.id = s.run",
    "decided": "SELECT e.*, r.status AS outcome, coalesce(r.status IN ('agreed', 'resolved_explicit_update'), false) AS settled FROM evidence e LEFT JOIN resolutions r ON r.id = e.resolution",
    "witnesses": "SELECT w.version, e.version AS of, e.verified FROM (SELECT version, unnest([intent_evidence, cross_evidence]) AS witness FROM resolutions) w JOIN evidence e ON e.id = w.witness",
    "amended": "SELECT s.version, s.relation, s.decision, coalesce(d.status = 'confirmed' AND (d.opportunity = v.opportunity OR d.other = v.opportunity), false) AS confirmed FROM versions v JOIN sources s ON s.version = v.id LEFT JOIN decisions d ON d.id = s.decision",
    "used": "SELECT u.version, d.sealed, d.status FROM (SELECT version, document FROM evidence UNION SELECT version, document FROM chunks) u JOIN documents d ON d.id = u.document",
}
_BROKEN = {
    "no source": "SELECT id FROM versions EXCEPT SELECT version FROM sources",
    "unconfirmed source": "SELECT version FROM mapped WHERE NOT (relationship = 'confirmed' AND n_sealed AND extracted)",
    "open conflict": "SELECT version FROM decided WHERE candidate = 'conflicting' AND NOT settled EXCEPT SELECT id FROM versions WHERE quality = 'needs_review'",
    "unresolved field": "SELECT version FROM resolutions WHERE status = 'unresolved' EXCEPT SELECT id FROM versions WHERE quality = 'needs_review'",
    "value is not its evidence": "SELECT r.version FROM resolutions r JOIN evidence e ON e.id = r.selected_evidence WHERE NOT (e.verified AND e.candidate = 'accepted' AND e.value IS NOT DISTINCT FROM r.selected_value)",
    "witness of another version": "SELECT version FROM witnesses WHERE NOT (verified AND of = version)",
    "superseded without decision": "SELECT version FROM decided WHERE candidate = 'superseded' AND outcome IS NOT NULL AND NOT settled",
    "two versions of one notice": "SELECT version FROM mapped WHERE current GROUP BY version, notice HAVING count(*) > 1",
    "no watched source": "SELECT id FROM versions EXCEPT SELECT version FROM sources WHERE current",
    "amendment without decision": "SELECT version FROM amended WHERE CASE WHEN decision IS NULL THEN relation IN ('extension', 'correction', 'cancellation', 'reopened') ELSE NOT confirmed END",
    "unsealed document": "SELECT version FROM used WHERE NOT (sealed AND status IN ('succeeded', 'partial'))",
    "incomplete provenance": "(SELECT version FROM mapped WHERE current AND assets <> 'complete' UNION SELECT version FROM used WHERE status <> 'succeeded') INTERSECT SELECT id FROM versions WHERE quality = 'complete'",
}


@query("DM-27_publication_guard", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in {**_PUBLICATION, **_JOINED}.items()) + " " + " UNION ALL ".join(
    f"SELECT id AS version, '{rule}' AS rule FROM versions WHERE id IN ({sql})" for rule, sql in _BROKEN.items()))
def publication_guard(spark, sf_dir):
    from palimpsest.operators.publication import publication_violations

    known = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "supplier")}
    sql = {k: re.sub(r"FROM (\w+)", r"FROM {\1}", v) for k, v in _PUBLICATION.items()}
    return publication_violations({k: spark.sql(v, **{t: known[t] for t in re.findall(r"\{(\w+)\}", v)}) for k, v in sql.items()})


@query("DM-28_rewritten_rows", """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'deleted' ELSE 'changed' END AS how FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0""")
def rewritten_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    after = orders.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return integrity.rewritten(orders, after, "o_orderkey", ["o_custkey", "o_totalprice", "o_orderstatus"])


#: Orders a day later: some are gone, some have another price or customer, some are new. Orders of 1996 and before are sealed.
_LATER = """
SELECT o_orderkey, CASE WHEN o_orderkey % 83 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, sealed FROM {o}
WHERE o_orderkey % 97 <> 0 OR o_orderkey > {most} / 2 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_totalprice, sealed FROM {o} WHERE o_orderkey % 101 = 0"""
_SEALED = "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN year(o_orderdate) <= 1996 THEN o_orderdate END AS sealed FROM {orders}"


@query("DM-28_guards", f"""
WITH b AS ({_SEALED.format(orders="orders")}), m AS (SELECT max(o_orderkey) AS most FROM b), a AS ({_LATER.format(o="b", most="(SELECT most FROM m)")}),
c AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS key, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS how, b.sealed, b.o_custkey AS bc, a.o_custkey AS ac
  FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey <> b.o_custkey OR a.o_totalprice <> b.o_totalprice),
f AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
SELECT 'append_only' AS rule, key, how FROM c WHERE how <> 'added' UNION ALL SELECT 'sealed', key, how FROM c WHERE how <> 'added' AND sealed IS NOT NULL
UNION ALL SELECT 'identity', key, how FROM c WHERE how = 'changed' AND bc <> ac UNION ALL SELECT 'frozen_child', key, how FROM c WHERE bc IN (FROM f) OR ac IN (FROM f)""")
def guards(spark, sf_dir):
    from palimpsest.operators.snapshots import changes, guard_violations, write_snapshot

    before = spark.sql(_SEALED, orders=table(spark, sf_dir, "orders"))
    after = spark.sql(_LATER.replace("{most}", "(SELECT max(o_orderkey) FROM {o})"), o=before)
    found = changes(spark, *[write_snapshot(df, key="o_orderkey") for df in (before, after)])
    finalized = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    return guard_violations(found, append_only=True, sealed="sealed", identity=["o_custkey"], parent="o_custkey", finalized=finalized)


@query("DM-29_pointer_guard", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def pointer_guard(spark, sf_dir):
    return integrity.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey").select("l_orderkey", "l_partkey")


#: Fetches: each event of a user and type; views say that nothing changed since the event `k` before them.
_FETCHES = """
SELECT event_id, user_id, event_type = 'view' AS unchanged, CASE WHEN event_type = 'view' THEN event_id - {k} END AS reuses, user_id % 3 AS asset, CASE WHEN value < 30 THEN 'received' ELSE 'failed' END AS got, ts FROM {events}"""


@query("DM-29_revalidation", f"""
WITH f AS ({_FETCHES.format(events='events', k="CAST(json_extract_string(props, '$.k') AS BIGINT) % 5")})
SELECT event_id FROM f WHERE unchanged AND NOT EXISTS (SELECT 1 FROM f p WHERE p.event_id = f.reuses AND p.user_id % 4 = f.user_id % 4 AND p.asset = f.asset AND (p.unchanged OR p.got = 'received') AND p.ts <= f.ts)""")
def revalidation(spark, sf_dir):
    fetches = spark.sql(_FETCHES.replace("{k}", "CAST(get_json_object(props, '$.k') AS BIGINT) % 5"), events=table(spark, sf_dir, "events"))
    outcome = F.when(F.col("unchanged"), "not_modified").otherwise(F.col("got"))
    rows = fetches.select("event_id", "reuses", (F.col("user_id") % 4).alias("resource"), "asset", outcome.alias("outcome"), "ts")
    return integrity.unfounded_revalidations(rows, key="event_id", reuses="reuses", same=["resource", "asset"], outcome="outcome", started="ts", finished="ts").select("event_id")


@query("DM-29_chunk_provenance", """
WITH s AS (SELECT l_orderkey AS chunk, l_partkey % 50 AS block, o_custkey % 10 AS document FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT chunk, count(DISTINCT block) AS foreign_blocks FROM s WHERE block % 10 <> document GROUP BY chunk""")
def chunk_provenance(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_partkey") % 50).alias("block"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), (F.col("o_custkey") % 10).alias("document"))
    blocks = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("block")).distinct().withColumn("document", F.col("block") % 10)
    return integrity.foreign_blocks(lines, chunks, blocks, chunk="chunk", block="block", document="document")


@query("DM-31_unprocessed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label > 2)")
def unprocessed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return docs.join(table(spark, sf_dir, "embeddings").where("label > 2").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("DM-32_missing_candidates", "SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_candidates(spark, sf_dir):
    k = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k IS NOT NULL").distinct()
    return k.join(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k", "left_anti")


@query("DM-33_config_precedence", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'ENV' END, 'DEFAULT') AS value,
  CASE WHEN c_acctbal > 5000 AND c_mktsegment IS NOT NULL THEN 'admin' WHEN c_custkey % 2 = 0 THEN 'env' ELSE 'default' END AS source FROM customer""")
def config_precedence(spark, sf_dir):
    admin, env = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.lit("ENV"))
    source = F.when(admin.isNotNull(), "admin").when(env.isNotNull(), "env").otherwise("default")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(admin, env, F.lit("DEFAULT")).alias("value"), source.alias("source"))


@query("DM-34_audit_subjects", """
SELECT 'customer' AS kind, c_custkey AS id, c_name AS title FROM customer WHERE c_custkey IN (SELECT user_id FROM events) UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT user_id FROM events)""")
def audit_subjects(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    c = table(spark, sf_dir, "customer").join(users, F.col("c_custkey") == F.col("user_id"), "left_semi").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    s = table(spark, sf_dir, "supplier").join(users, F.col("s_suppkey") == F.col("user_id"), "left_semi").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return c.unionByName(s)


#: Audit rows of eleven kinds, some of entities that aren't there or have no number.
_AUDIT = """
SELECT event_id, ['customer', 'supplier', 'part', 'order', 'nation', 'region', 'document', 'page', 'setting', 'job', 'unknown'][{first} + event_id % 11] AS kind,
  CASE WHEN event_id % 13 = 0 THEN 'x' || user_id ELSE '' || user_id END AS entity FROM events"""


@query("DM-34_subjects_of_all_kinds", f"""
WITH a AS ({_AUDIT.format(first=1)}), s AS (
  SELECT 'customer' AS kind, c_custkey AS id, c_name AS subject, '/customers/' || c_custkey AS link FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, '/suppliers/' || s_suppkey FROM supplier
  UNION ALL SELECT 'part', p_partkey, p_name, '/brands/' || p_brand FROM part UNION ALL SELECT 'order', o_orderkey, o_orderpriority, '/customers/' || o_custkey FROM orders
  UNION ALL SELECT 'nation', n_nationkey, n_name, '/nations' FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, '/regions' FROM region
  UNION ALL SELECT 'document', doc_id, source, '/documents/' || doc_id FROM documents UNION ALL SELECT 'page', page_id, url, '/pages/' || page_id FROM pages)
SELECT event_id, a.kind, entity, CASE a.kind WHEN 'setting' THEN '/settings' WHEN 'job' THEN '/jobs' ELSE link END AS link, CASE WHEN a.kind = 'setting' THEN entity ELSE subject END AS subject
FROM a LEFT JOIN s ON s.kind = a.kind AND s.id::VARCHAR = entity""")
def subjects_of_all_kinds(spark, sf_dir):
    rows = lambda name, key: table(spark, sf_dir, name).withColumn("id", F.col(key))
    to = lambda where, key="id": F.concat(F.lit(f"/{where}/"), F.col(key).cast("string"))
    kinds = {
        "customer": (rows("customer", "c_custkey"), F.col("c_name"), to("customers")), "supplier": (rows("supplier", "s_suppkey"), F.col("s_name"), to("suppliers")),
        "part": (rows("part", "p_partkey"), F.col("p_name"), to("brands", "p_brand")), "order": (rows("orders", "o_orderkey"), F.col("o_orderpriority"), to("customers", "o_custkey")),
        "nation": (rows("nation", "n_nationkey"), F.col("n_name"), F.lit("/nations")), "region": (rows("region", "r_regionkey"), F.col("r_name"), F.lit("/regions")),
        "document": (rows("documents", "doc_id"), F.col("source"), to("documents")), "page": (rows("pages", "page_id"), F.col("url"), to("pages")),
        "setting": (None, F.col("entity"), F.lit("/settings")), "job": (None, None, F.lit("/jobs")),
    }
    names = [*kinds, "unknown"]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 11 + 1).cast("int"))
    entity = F.concat(F.when(F.col("event_id") % 13 == 0, "x").otherwise(""), F.col("user_id").cast("string"))
    audit = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), entity.alias("entity"))
    return records.resolve_subjects(audit, kinds, kind="kind", entity="entity")


@query("DM-35_dashboard", """
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open FROM nation
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def dashboard(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    joined = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("open"))


@query("DM-35_three_dashboards", """
SELECT 'funnel' AS panel, NULL AS label, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'queue', event_type, CASE WHEN value < 10 THEN 'waiting' WHEN value < 20 THEN 'running' ELSE 'failed' END, count(*) FROM events GROUP BY 2, 3
UNION ALL SELECT 'reviews', CAST(quality AS VARCHAR), NULL, count(*) FROM labels WHERE toxic = 0 GROUP BY quality""")
def three_dashboards(spark, sf_dir):
    from palimpsest.operators.dashboards import dashboards, typed

    at = F.when(F.col("value") < 10, "waiting").when(F.col("value") < 20, "running").otherwise("failed")
    facts = typed(table(spark, sf_dir, "orders"), "notice", kind=F.col("o_orderpriority"), status=F.col("o_orderstatus"))
    facts = facts.unionByName(typed(table(spark, sf_dir, "events"), "job", kind=F.col("event_type"), status=at))
    facts = facts.unionByName(typed(table(spark, sf_dir, "labels"), "review", kind=F.col("quality"), status=F.when(F.col("toxic") == 0, "open").otherwise("done")))
    return dashboards(facts, {"funnel": ("notice", "status", ()), "queue": ("job", "both", ()), "reviews": ("review", "kind", ("open",))})


@query("DM-16_apply_revision", """
SELECT l_orderkey, l_partkey, l_suppkey, l_orderkey + 1000000 AS version, CASE WHEN n IS NOT NULL THEN n ELSE q END AS quantity, n IS NOT NULL AS revised
FROM (SELECT l_orderkey, l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)
LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, min(l_quantity) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3) USING (l_orderkey, l_partkey, l_suppkey)""")
def apply_revision(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem")
    base = lines.groupBy(*keys).agg(F.max("l_quantity").alias("quantity")).withColumn("version", F.col("l_orderkey"))
    patches = lines.where("l_returnflag = 'R'").groupBy(*keys).agg(F.min("l_quantity").alias("quantity"))
    return records.apply_revision(base, patches, version="version", new_version=F.col("version") + 1_000_000, key=keys, value="quantity")


@query("DM-24_review_policy", """
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'purchase') THEN 'ignore' WHEN event_type = 'click' AND value >= 50 THEN 'apply' ELSE 'escalate' END AS action FROM events""")
def review_policy(spark, sf_dir):
    confidence = F.when(F.col("value") >= 50, "high").otherwise("low")
    return table(spark, sf_dir, "events").select("event_id", records.review_action(F.col("event_type"), confidence, ["click"], ["click", "purchase"]).alias("action"))


#: Reviews of events: kinds, verdicts and corrections by the event's numbers.
_VERDICTS = "['dismiss', 'fix', 'merge', 'revise', 'unsure']"
_PATHS = "['title', 'selection_capacity', 'windows/3/end_date', 'benefits/1/amount_min', 'published_at', 'academic_term']"
_VALUES = "['x', '12', '2026-02-28', '1,000', 'fall', '-3']"


@query("DM-24_review_outcomes", f"""
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'identity_uncertain' WHEN 'view' THEN 'revision_candidate' WHEN 'error' THEN 'parsing_failed' ELSE 'other' END AS kind, event_type <> 'signup' AS flags,
  value >= 10 AS sure, {_VERDICTS}[1 + user_id % 5] AS verdict, {_PATHS}[1 + event_id % 6] AS path, {_VALUES}[1 + event_id // 6 % 6] AS v, event_id % 4 AS a, event_id % 3 AS b, user_id % 2 = 0 AS published FROM events),
c AS (SELECT *, CASE path WHEN 'title' THEN true WHEN 'selection_capacity' THEN v = '12' WHEN 'windows/3/end_date' THEN v = '2026-02-28' WHEN 'benefits/1/amount_min' THEN v IN ('12', '1,000') WHEN 'academic_term' THEN v = 'fall' ELSE false END AS allowed FROM e)
SELECT event_id, CASE WHEN kind = 'parsing_failed' OR kind = 'other' AND NOT flags THEN 'people' WHEN NOT sure THEN 'escalated' WHEN verdict = 'dismiss' THEN 'dismissed'
  WHEN verdict = 'fix' AND kind = 'other' AND NOT published AND allowed THEN 'corrected' WHEN verdict = 'merge' AND kind = 'identity_uncertain' AND a <> b AND a < 3 THEN 'merged'
  WHEN verdict = 'revise' AND kind = 'revision_candidate' AND a <> b + 1 AND b < 2 THEN 'revised' ELSE 'escalated' END AS outcome FROM c""")
def review_outcomes(spark, sf_dir):
    from palimpsest.operators.review import review_outcome

    e = lambda sql: F.expr(sql.replace("[1 + ", "[").replace("['", "array('").replace("']", "')").replace("//", "div"))
    events = table(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'click' THEN 'identity_uncertain' WHEN 'view' THEN 'revision_candidate' WHEN 'error' THEN 'parsing_failed' ELSE 'other' END")
    item = F.struct(kind.alias("kind"), F.lit("opportunity_version").alias("entity"), (F.col("event_type") != "signup").alias("has_flags"), (F.col("user_id") % 2 == 0).alias("published"),
                    F.array(*map(F.lit, (0, 1, 2))).cast("array<bigint>").alias("related"), F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("own"))
    a, b = F.col("event_id") % 4, F.col("event_id") % 3
    fix = F.struct(e(f"{_PATHS}[1 + event_id % 6]").alias("path"), e(f"{_VALUES}[1 + event_id // 6 % 6]").alias("value"))
    revisions = F.array(F.struct(a.alias("target"), F.array(b).alias("merged")), F.struct((b + 1).alias("target"), F.array(b).alias("merged")))
    said = F.struct(e(f"{_VERDICTS}[1 + user_id % 5]").alias("verdict"), F.when(F.col("value") >= 10, "high").otherwise("low").alias("confidence"), F.array(fix).alias("corrections"), F.array(a, b).alias("same"), revisions.alias("revisions"))
    return events.select("event_id", review_outcome(item, said).alias("outcome"))
