"""Document operators (DOC) and sources on pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import html
from palimpsest.operators.blocks import extraction_input, lines, stable_key
from palimpsest.operators.packing import small_text_batches
from palimpsest.plans.registry import query, table


def _pages(spark, sf_dir):
    small_text_batches(spark)
    return table(spark, sf_dir, "pages")


@query("DOC-01_html_blocks")
def html_blocks(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(html.html_blocks("html")).alias("pos", "b"))
    return rows.select("page_id", stable_key("html", F.col("pos")).alias("block_key"), "b.kind", "b.text", "b.xpath")


@query("DOC-01_block_counts", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-4][ >]')) AS BIGINT) AS headings FROM pages WHERE len(regexp_extract_all(html, '<h[1-4][ >]')) > 0""")
def block_counts(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.explode(html.html_blocks("html")).alias("b")).where("b.kind = 'heading'")
    return rows.groupBy("page_id").agg(F.count("*").alias("headings"))


@query("DOC-02_table_grid", """
SELECT l_orderkey, string_agg(l_linenumber || chr(9) || l_returnflag || chr(9) || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS grid FROM lineitem GROUP BY l_orderkey HAVING count(*) > 0""")
def table_grid(spark, sf_dir):
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td colspan=2>"), "l_returnflag", F.lit("</td></tr>"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", row.alias("r")))).alias("x"))
    made = rows.select("l_orderkey", F.concat(F.lit("<table>"), F.array_join("x.r", ""), F.lit("</table>")).alias("html"))
    return made.select("l_orderkey", F.element_at(html.html_blocks("html"), 1)["text"].alias("grid"))


@query("DOC-03_block_keys", """
SELECT doc_id, 'body:' || format('{:06d}', pos - 1) AS block_key FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""")
def block_keys(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents"), key="doc_id", text="text").select("doc_id", stable_key("body", F.col("pos")).alias("block_key"))


@query("DOC-05_page_details")
def page_details(spark, sf_dir):
    b = html.html_blocks("html")
    rows = _pages(spark, sf_dir).select("page_id", b.alias("b"), F.size(html.html_links("html")).alias("n_links"))
    return rows.select("page_id", F.try_element_at(F.filter("b", lambda x: x["kind"] == "heading"), F.lit(1))["text"].alias("title"), F.size("b").alias("n_blocks"), "n_links")


@query("DOC-06_rendered_text")
def rendered_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.html_text("html").alias("body"))


@query("DOC-07_fingerprint")
def fingerprint(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.html_fingerprint("html").alias("fingerprint"))


@query("DOC-08_revision_signals")
def revision_signals(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.explode(html.signals(html.html_text("html"))).alias("s"))
    return rows.select("page_id", "s.kind", "s.offset", "s.context")


@query("DOC-09_references", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS links, count(*) FILTER (WHERE regexp_extract(href, '^https?://([^/]+)', 1) = regexp_extract(url, '^https?://([^/]+)', 1)) AS same_host FROM l GROUP BY page_id""")
def references(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", "url", F.explode(html.html_links("html")).alias("l"))
    host = lambda u: F.regexp_extract(u, "^https?://([^/]+)", 1)
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(host(F.col("l.href")) == host(F.col("url"))).alias("same_host"))


@query("DOC-18_transcription_blocks")
def transcription_blocks(spark, sf_dir):
    small_text_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(html.text_blocks("text")).alias("pos", "b"))
    return rows.select("conv_id", "turn", "pos", "b.kind", F.md5("b.text").alias("text_md5"))


@query("DOC-19_title_block", """
SELECT doc_id, 'block:000000' AS block_key, source AS text FROM documents UNION ALL
SELECT doc_id, 'block:' || format('{:06d}', pos), line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)""")
def title_block(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_prepend(F.split("text", "\n", -1), F.col("source")).alias("b"))
    return docs.select("doc_id", F.posexplode("b").alias("pos", "text")).select("doc_id", stable_key("block", F.col("pos")).alias("block_key"), "text")


@query("DOC-20_parse_cache", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS parsed_from FROM documents""")
def parse_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("parsed_from"))
    return docs.join(first, docs.sha.eqNullSafe(first.sha)).select("doc_id", "parsed_from")


@query("DOC-21_latest_parse", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS document FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey""")
def latest_parse(spark, sf_dir):
    sealed = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return sealed.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("document"))


@query("DOC-22_extraction_input", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_blocks, sha256(string_agg(sha256(line), chr(10) ORDER BY pos)) AS input_sha256 FROM l WHERE trim(line) <> '' AND line NOT IN (SELECT line FROM b) GROUP BY doc_id""")
def extraction(spark, sf_dir):
    return extraction_input(table(spark, sf_dir, "documents"), key="doc_id", text="text")


@query("SRC-02_later_pages_win", """
SELECT event_id % 1000 AS article, arg_max(event_type, (event_id // 1000, event_id)) AS title FROM events GROUP BY 1""")
def later_pages_win(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("article"), F.floor(F.col("event_id") / 1000).alias("page"), "event_id", "event_type")
    return rows.groupBy("article").agg(F.max_by("event_type", F.struct("page", "event_id")).alias("title"))


@query("SRC-02_paged_crawl", """
WITH l AS (SELECT 1 + page_id // 40 AS page, page_id % 170 AS article, url FROM pages WHERE 1 + page_id // 40 <> 2)
SELECT CAST(page AS INT) AS page, article, url AS title, NULL AS error FROM l QUALIFY row_number() OVER (PARTITION BY article ORDER BY page DESC, url DESC) = 1 UNION ALL SELECT 2, NULL, NULL, 'missing'""")
def paged_crawl(spark, sf_dir):
    import uuid

    from palimpsest.operators.lineage import shared_folder
    from palimpsest.sources import paged

    # The saved list: 40 entries a page, the second page lost, and articles that come again on later pages.
    rows = table(spark, sf_dir, "pages").select((1 + F.floor(F.col("page_id") / 40)).cast("int").alias("page"), (F.col("page_id") % 170).alias("article"), F.col("url").alias("title"))
    path = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    total = F.broadcast(rows.agg(F.max("page").alias("total_pages")))  # one row
    rows.crossJoin(total).where("page <> 2").repartition("page").write.partitionBy("page").json(path)
    return paged.later_pages_win(paged.crawl(spark, path), key="article").select("page", "article", "title", "error")


@query("SRC-08_saved_files", """
WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1.7' WHEN 2 THEN 'GIF89a' ELSE 'PK' || chr(3) || chr(4) END || html || chr(10) AS content, html FROM pages WHERE html IS NOT NULL),
k AS (SELECT page_id, strlen(content) AS length, sha256(content) AS sha, CASE page_id % 4 WHEN 1 THEN 'pdf' WHEN 2 THEN 'gif' WHEN 3 THEN 'binary'
  ELSE CASE WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'html' ELSE 'txt' END END AS format FROM f)
SELECT page_id, length, sha, format, CASE WHEN format IN ('binary', 'txt') THEN 'unsupported' WHEN format = 'pdf' AND page_id % 3 <> 0 THEN 'pdf_hybrid' ELSE 'direct' END AS parser,
  CASE WHEN format IN ('binary', 'txt') THEN 'unsupported' WHEN page_id % 9 = 0 THEN 'failed' WHEN format = 'pdf' AND page_id % 3 = 0 THEN 'partial' ELSE 'succeeded' END AS status,
  array_to_string(list_filter([CASE WHEN format = 'pdf' AND page_id % 3 = 0 THEN 'pdf_hybrid_failed:TimeoutError' END, CASE WHEN format IN ('pdf', 'gif', 'html') AND page_id % 9 = 0 THEN 'direct_failed:ValueError' END,
    CASE WHEN format IN ('binary', 'txt') THEN 'unsupported:' || format END], lambda x: x IS NOT NULL), ' ') AS flags FROM k""")
def saved_files(spark, sf_dir):
    import uuid

    from palimpsest.operators.lineage import shared_folder
    from palimpsest.operators.packing import small_text_batches
    from palimpsest.sources.registry import routed, save_each, scan_saved

    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    before = F.element_at(F.array(F.lit(""), F.lit("%PDF-1.7"), F.lit("GIF89a"), F.lit("PK\x03\x04")), (F.col("page_id") % 4 + 1).cast("int"))
    folder = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    small_text_batches(spark)
    name = F.format_string("page_id=%d-%d.txt", "page_id", F.monotonically_increasing_id())
    save_each(pages.select(name.alias("name"), F.concat(before, "html", F.lit("\n")).alias("content")), folder, name="name", content="content")
    files = scan_saved(spark, folder, names="*.txt").withColumn("page_id", F.regexp_extract("path", "page_id=(-?[0-9]+)-", 1).cast("long")).drop("path", "confidence")
    failed = lambda every, parser, error: pages.where(F.col("page_id") % every == 0).select("page_id", F.lit(parser).alias("parser"), F.lit(error).alias("error"))
    failures = failed(3, "pdf_hybrid", "TimeoutError").unionByName(failed(9, "direct", "ValueError"))
    return routed(files, failures, key="page_id").withColumn("flags", F.array_join("flags", " "))


@query("DOC-04_list_items")
def list_items(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", html.html_list("html", "url").alias("l"))
    return rows.select("page_id", "l.ok", "l.error", F.size("l.items").alias("n_items"), "l.items")
