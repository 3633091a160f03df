"""The numbered queries and the pipeline, with SQL oracles where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontamination, hard_negatives, language_id, line_dedup, merkle, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, warc
from palimpsest.llm.common import held_out, table


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_quality_rules(docs, model).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_language_model(docs)
    found = language_id.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit_quality_classifier(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM src),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos,
    CAST(sum(source_size) OVER () AS BIGINT)
      - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
    CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM w),
lvl AS (SELECT remaining, weights FROM o WHERE cap * weights >= weight * remaining ORDER BY pos LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN source_size = 0 THEN 0.0::DOUBLE
      WHEN cap * lvl.weights < weight * lvl.remaining THEN cap::DOUBLE
      ELSE (weight * lvl.remaining)::DOUBLE / lvl.weights::DOUBLE END AS target,
    CAST('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM o, lvl),
r AS (
  SELECT s.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) AS pos
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(greatest(CAST(floor(rate * pos::DOUBLE + u) AS BIGINT) - CAST(floor(rate * (pos - 1)::DOUBLE + u) AS BIGINT), 0), 3) AS BIGINT) AS taken
FROM r
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.remove_repeated_windows(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN f USING (h) WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n_removed IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda q: NOT list_contains(qs, q)), lambda q: w[q]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_spread_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 8)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = chat.transcripts(table(spark, sf_dir, "conversations"))
    found = chat.format_chats(known, chat.fit_chat_model(known))
    return found.select("conv_id", held_out("conv_id").alias("held_out"), "n_turns", F.array_join("turns.role", ",").alias("roles"), "rendered")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeated_strings(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.col("doc_id").isNotNull() & held_out("doc_id")
    return merkle.build_manifest(docs, tampered=tampered, becomes=F.translate("text", upper, lower)).check()


OP12_SQL = r"""
WITH RECURSIVE bits(doc_id, s, p, crc) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, p + 1, list_reduce([xor(crc, ascii(s[p])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)
  FROM bits WHERE p <= length(s)),
ids AS (SELECT doc_id, xor(crc, 4294967295::BIGINT) AS crc FROM bits WHERE p = length(s) + 1),
d AS (
  SELECT doc_id, source, sha256(f || t) AS leaf, sha256(f || CASE WHEN c THEN l ELSE t END) AS used FROM (
    SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS f,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS t,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS l,
      coalesce(crc % 5 = 0, false) AS c
    FROM documents LEFT JOIN ids USING (doc_id))),
s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
node(lvl, source, pos, h, n) AS (
  SELECT 0, source, pos, leaf, n FROM s0
  UNION ALL
  SELECT lvl + 1, source, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM node WHERE n > 1 GROUP BY lvl, source, pos // 16, n),
sub AS (SELECT source, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS places FROM node WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, place, subroot, places FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
k AS (SELECT row_number() OVER () AS k, s0.*, depth, place, subroot FROM s0 JOIN sub ON sub.source IS NOT DISTINCT FROM s0.source),
step AS (
  SELECT k.k, a.lvl, a.pos < (k.pos >> (4 * a.lvl)) AS earlier, a.pos, a.h
  FROM k JOIN node a ON a.source IS NOT DISTINCT FROM k.source AND a.lvl < depth AND a.pos >> 4 = k.pos >> (4 * a.lvl + 4) AND a.pos <> k.pos >> (4 * a.lvl)
  UNION ALL
  SELECT k.k, depth + a.lvl, a.pos < (place >> (4 * a.lvl)), a.pos, a.h
  FROM k JOIN top a ON a.n > 1 AND a.pos >> 4 = place >> (4 * a.lvl + 4) AND a.pos <> place >> (4 * a.lvl)),
run AS (SELECT k, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE earlier), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT earlier), '') AS r FROM step GROUP BY k, lvl),
proof AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM run GROUP BY k),
height AS (SELECT max(lvl) AS high FROM top),
fold(k, lvl, h) AS (
  SELECT k, 0, used FROM k
  UNION ALL
  SELECT f.k, f.lvl + 1, sha256(coalesce(l, '') || f.h || coalesce(r, '')) FROM fold f JOIN k USING (k) CROSS JOIN height LEFT JOIN run ON run.k = f.k AND run.lvl = f.lvl WHERE f.lvl < depth + high)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM k CROSS JOIN root CROSS JOIN height JOIN fold ON fold.k = k.k AND fold.lvl = depth + high LEFT JOIN proof ON proof.k = k.k
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_pages(spark, warc.write_pages(pages), pages.schema["page_id"].dataType.simpleString())


OP13_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex, md5(coalesce(html, '')) AS key FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
    row_number() OVER (PARTITION BY hex, key ORDER BY page_id) AS place, min(page_id) OVER (PARTITION BY hex, key) AS least
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN least END AS refers_to
FROM b
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op8_mixing": op8_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}
_ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_warc": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _ORACLES.items() if v is not None}
