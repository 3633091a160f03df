"""Hybrid search and its parts (RT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.vectors import cosine_distance
from palimpsest.operators.predicates import exists_child
from palimpsest.operators.retrieval import bm25, embedded, hybrid_search, query_terms, search_all, term_share, tokens
from palimpsest.plans.registry import query, table

#: A request in two of the documents' languages.
_REQUEST = "The São größer"
_TERMS = query_terms(_REQUEST)
#: Distinct tokens of x in DuckDB.
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))"

#: Lexical, vector and title score of every document for one request in DuckDB.
_SCORES = f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
lex AS (SELECT doc_id, round(len(list_intersect({_TOKENS.format(x='text')}, [{', '.join(repr(t) for t in _TERMS)}])) / {len(_TERMS)}.0::DOUBLE, 6) AS lexical FROM documents),
vec AS (SELECT vec_id, max(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])) AS v FROM embeddings, q GROUP BY vec_id),
s AS (SELECT doc_id, lexical, round(coalesce(v, 0.0), 6) AS vector FROM lex LEFT JOIN vec ON vec_id = doc_id)
"""

#: The best 20 documents for each document whose id is divisible by 50, by all its tokens and its vector.
_ALL = f"""
WITH t AS (SELECT doc_id, {_TOKENS.format(x='text')} AS t FROM documents),
v AS (SELECT vec_id, embedding AS e FROM embeddings),
q AS (SELECT doc_id AS q_id, t AS terms, e AS q FROM t LEFT JOIN v ON vec_id = doc_id WHERE doc_id % 50 = 0),
o AS (SELECT q_id, doc_id, count(*) AS n FROM (SELECT q_id, unnest(terms) AS tok FROM q) JOIN (SELECT doc_id, unnest(t) AS tok FROM t) USING (tok) GROUP BY 1, 2),
s AS (SELECT q_id, t.doc_id, CASE WHEN len(terms) = 0 THEN 0.0 ELSE round(coalesce(n, 0) / len(terms)::DOUBLE, 6) END AS lexical,
  round(coalesce(list_cosine_similarity(q::DOUBLE[], e::DOUBLE[]), 0.0), 6) AS vector FROM q CROSS JOIN t LEFT JOIN o USING (q_id, doc_id) LEFT JOIN v ON vec_id = t.doc_id),
r AS (SELECT *, round(lexical * W0 + vector * W1, 8) AS score FROM s)
SELECT q_id, doc_id, lexical, vector, score FROM r QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) <= 20
"""


def _weighted(lexical, vector):
    return _ALL.replace("W0", str(lexical)).replace("W1", str(vector))


def _search_all(spark, sf_dir, mode):
    docs, vectors = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "embeddings")
    asked = docs.where("doc_id % 50 = 0").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return search_all(asked.select(F.col("doc_id").alias("q_id"), F.col("text").alias("query"), F.col("embedding").alias("vector")), docs, vectors, key="doc_id", text="text", mode=mode)


@query("RT-06_hybrid_search", _weighted(0.45, 0.55))
def hybrid(spark, sf_dir):
    return _search_all(spark, sf_dir, "hybrid")


@query("RT-04_lexical_mode", _weighted(1, 0))
def lexical(spark, sf_dir):
    return _search_all(spark, sf_dir, "lexical")


@query("RT-05_vector_mode", _weighted(0, 1))
def vector(spark, sf_dir):
    return _search_all(spark, sf_dir, "vector")


def _request(spark, sf_dir, **options):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    return hybrid_search(
        exists_child(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "of"), "doc_id", "of", F.col("quality") == 1), vectors,
        key="doc_id", text="text", title="source", published="n_chars", query=_REQUEST,
        where=F.col("lang").isin("en", "de", "fr", "es", "pt") | (F.col("n_chars") >= 100), **{"query_vector": first["embedding"] if first else None} | options)


def _request_sql(w0, w1, vector, limit, extra=""):
    from palimpsest.plans.joins import GRAMS

    q = f"'{_REQUEST.lower()}'"
    return _SCORES + f""", g AS (SELECT doc_id, n_chars, {GRAMS.format(x="lower(coalesce(source, ''))")} AS a, {GRAMS.format(x=q)} AS b FROM documents
  WHERE (lang IN ('en', 'de', 'fr', 'es', 'pt') OR n_chars >= 100) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
f AS (SELECT doc_id, n_chars, round(greatest(lexical, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END), 6) AS lexical, {vector} AS vector FROM g JOIN s USING (doc_id))
SELECT doc_id, lexical, vector, round(lexical * {w0} + vector * {w1}, 8) AS score{extra} FROM f ORDER BY score DESC, n_chars DESC NULLS FIRST, doc_id {limit}"""


@query("RT-06_filtered_search", _request_sql(0.45, 0.55, "vector", "LIMIT 20 OFFSET 5"))
def filtered(spark, sf_dir):
    return _request(spark, sf_dir, offset=5)


@query("RT-07_degraded_search", _request_sql(0.45, 0.55, "0.0::DOUBLE", "LIMIT 20", ", 'ConnectionError: no embedding service' AS vector_error"))
def degraded(spark, sf_dir):
    def embed(text):
        raise ConnectionError("no embedding service")

    vector, error = embedded(embed, _REQUEST, "hybrid")
    return _request(spark, sf_dir, query_vector=vector).withColumn("vector_error", F.lit(error))


@query("SO-09_vector_top", """
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY distance, vec_id LIMIT 30""")
def vector_top(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = vectors.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(30)


@query("RT-01_chunk_text", "SELECT p_partkey, concat_ws(chr(10), p_name, nullif(p_brand, ''), nullif(p_type, 'PROMO')) AS chunk FROM part")
def chunk_text(spark, sf_dir):
    parts = [F.col("p_name"), F.nullif(F.col("p_brand"), F.lit("")), F.nullif(F.col("p_type"), F.lit("PROMO"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", *parts).alias("chunk"))


@query("RT-02_token_postings", r"""
SELECT token, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY token""")
def token_postings(spark, sf_dir):
    postings = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return postings.groupBy("token").agg(F.count("*").alias("docs"))


@query("RT-03_bm25", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
f AS (SELECT doc_id, len(t) AS size, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'of')) AS f1 FROM t),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM f)
SELECT doc_id, round(ln(1 + (n - n0 + 0.5) / (n0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1 + (n - n1 + 0.5) / (n1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score
FROM f, s WHERE f0 > 0 OR f1 > 0""")
def bm25_query(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), ["the", "of"], key="doc_id", text="text").select("doc_id", F.round("score", 6).alias("score"))


#: Questions of the customers whose key is divisible by 20, with words that items have, and the day they are asked.
_QUESTION = "CASE (c_custkey // 20) % 4 WHEN 0 THEN '서울특별시 거주 대학생 등록금' WHEN 1 THEN '경상남도에 사는 석사, ' || CAST(1 + c_custkey % 50 AS {s}) || '만원 이상' WHEN 2 THEN '소득 ' || CAST(c_custkey % 10 AS {s}) || '구간 이하 이번 달 신청 가능' ELSE '' END || ' ' || CASE WHEN c_acctbal > 5000 THEN 'red ring promo' ELSE 'small widget' END"
_TODAY = "1996-02-10"
#: Items with what their children state: windows and amounts of their lines; levels, regions, brackets of themselves.
_OFFERS = """
SELECT p_partkey, p_name, p_type, CASE WHEN p_size % 9 > 0 THEN p_size END AS day, p_size % 2 = 1 AS for_levels, CASE WHEN p_size % 4 = 1 THEN 'graduate' ELSE 'undergraduate' END AS level,
  CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'tuition' ELSE 'housing' END AS kind, p_size % 10 AS bracket, p_size % 3 = 0 AS for_regions, CASE WHEN p_partkey % 2 = 0 THEN '서울특별시' ELSE '경남 창원' END AS region,
  first_end, ends, amount, open FROM part LEFT JOIN (
    SELECT l_partkey, max(l_quantity) * 10000 AS amount, min(CAST(l_shipdate AS DATE)) AS first_end, max(CAST(l_shipdate AS DATE)) AS ends,
      max(CASE WHEN l_shipdate <= {ts} '1996-02-10' AND l_shipdate >= {ts} '1995-02-10' THEN 1 ELSE 0 END) = 1 AS open FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"""
_QUESTIONS_SQL = f"""
WITH q AS (SELECT c_custkey AS q_id, {_QUESTION.format(s='VARCHAR')} AS query, (c_custkey // 20) % 4 AS form, c_custkey, embedding AS q FROM customer LEFT JOIN embeddings ON vec_id = c_custkey WHERE c_custkey % 20 = 0),
x AS ({_OFFERS.format(ts='TIMESTAMP')}),
p AS (SELECT * FROM q JOIN x ON CASE form
  WHEN 0 THEN (NOT for_levels OR level = 'undergraduate') AND kind = 'tuition' AND (NOT for_regions OR region LIKE '서울%' OR '서울' LIKE region || '%')
  WHEN 1 THEN (NOT for_levels OR level = 'graduate') AND amount >= (1 + c_custkey % 50) * 10000 AND (NOT for_regions OR region LIKE '경남%' OR '경남' LIKE region || '%')
  WHEN 2 THEN bracket <= c_custkey % 10 AND ends >= DATE '{_TODAY}' AND first_end <= DATE '1996-02-29' AND open ELSE true END),
t AS (SELECT *, {_TOKENS.format(x='query')} AS qt, {_TOKENS.format(x="p_type || ' ' || p_name")} AS xt, {{grams_name}} AS a, {{grams_query}} AS b FROM p),
s AS (SELECT q_id, p_partkey, day, round(greatest(len(list_intersect(qt, xt)) / len(qt)::DOUBLE, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END), 6) AS lexical,
  round(coalesce(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 0.0), 6) AS vector FROM t LEFT JOIN embeddings ON vec_id = p_partkey),
r AS (SELECT *, round(lexical * 0.45 + vector * 0.55, 8) AS score FROM s)
SELECT q_id, p_partkey, lexical, vector, score FROM r QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, day DESC NULLS FIRST, p_partkey) <= 10
"""


def _with_grams(sql):
    from palimpsest.plans.joins import GRAMS

    return sql.replace("{grams_name}", GRAMS.format(x="lower(p_name)")).replace("{grams_query}", GRAMS.format(x="lower(query)"))


@query("FLT-14_question_search", _with_grams(_QUESTIONS_SQL))
def question_search(spark, sf_dir):
    from palimpsest.operators.predicates import admitted, bidirectional_prefix, question_filters, restricted_or_match

    tables = {t: table(spark, sf_dir, t) for t in ("part", "lineitem")}
    offers = spark.sql(_OFFERS.format(ts="TIMESTAMP").replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}"), **tables)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    question = F.expr(_QUESTION.format(s="STRING").replace("//", "div"))
    asked = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("q_id"), question.alias("query"))
    asked = asked.withColumn("filters", question_filters(F.col("query"), F.lit(_TODAY).cast("date")))
    asked = asked.join(vectors.withColumnsRenamed({"vec_id": "q_id", "embedding": "vector"}), "q_id", "left")
    rule = lambda restricted: F.when(F.col(restricted), "restricted").otherwise("unrestricted")
    conditions = {
        "student_type": lambda x: restricted_or_match(rule("for_levels"), F.col("level") == x), "benefit_type": lambda x: F.col("kind") == x,
        "status": lambda x: F.col("open"), "end_from": lambda x: F.col("ends") >= x, "end_to": lambda x: F.col("first_end") <= x, "min_amount": lambda x: F.col("amount") >= x,
        "income_bracket_max": lambda x: F.col("bracket") <= x, "region": lambda x: restricted_or_match(rule("for_regions"), bidirectional_prefix(F.array("region"), x)),
    }
    items, asked = admitted(offers.withColumn("text", F.concat_ws(" ", "p_type", "p_name")), asked, "filters", conditions, "admitted")
    return search_all(asked, items, vectors, key="p_partkey", text="text", title="p_name", published="day", group="admitted", top=10, alike=True)


#: BM25 of each benchmark item's distinct tokens against every document in DuckDB.
_RANKED = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS f FROM w GROUP BY 1, 2),
z AS (SELECT doc_id, sum(f) AS size FROM f GROUP BY 1),
m AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, m GROUP BY term, n),
q AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN i USING (term) JOIN f USING (term) JOIN z USING (doc_id), m GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS place FROM s
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("RT-03_bm25_postings", _RANKED)
def bm25_postings(spark, sf_dir):
    from palimpsest.operators.postings import build_postings, search_postings

    index = build_postings(table(spark, sf_dir, "documents"), key="doc_id", text="text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("query"))
    return search_postings(index, items, top=10, key="doc_id")[0].withColumnRenamed("q_id", "item_id")


@query("RT-08_empty_query", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def empty_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", term_share(F.col("text"), []).alias("score"), "n_chars").orderBy(F.col("score").desc(), F.col("n_chars").desc(), "doc_id").limit(20).select("doc_id", "score")


@query("RT-09_profile_keys", "SELECT DISTINCT 'local:' || lang || ':64:lines' AS profile, sha256('local:' || lang || ':64:lines') AS config_sha FROM documents")
def profile_keys(spark, sf_dir):
    key = F.concat_ws(":", F.lit("local"), "lang", F.lit("64"), F.lit("lines"))
    return table(spark, sf_dir, "documents").select(key.alias("profile")).distinct().select("profile", F.sha2("profile", 256).alias("config_sha"))


@query("RT-10_backfill_queue", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def backfill_queue(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(have, "doc_id", "left_anti")


@query("RT-11_activation", "SELECT lang, count(*) AS total, count(vec_id) AS embedded, count(*) = count(vec_id) AS can_activate FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY lang")
def activation(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(have, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("total"), F.count("has").alias("embedded"), (F.count("*") == F.count("has")).alias("can_activate"))


@query("RT-12_search_debug", _SCORES + "SELECT doc_id, lexical, vector FROM s")
def search_debug(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = vectors.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), (F.lit(1.0) - cosine_distance(F.col("embedding"), F.col("q"))).alias("v"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(term_share(F.col("text"), _TERMS), 6).alias("lexical"))
    return docs.join(near, "doc_id", "left").select("doc_id", "lexical", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("vector"))


@query("RT-13_hash_embedding", r"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM t),
s AS (SELECT doc_id, (h >> 1) % 64 AS at_, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1),
g AS (SELECT doc_id, unnest(range(64)) AS at_ FROM documents)
SELECT doc_id, list(CASE WHEN n > 0 THEN round(coalesce(x, 0.0) / n, 5) ELSE 0.0 END ORDER BY at_) AS vector FROM g LEFT JOIN s USING (doc_id, at_) LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def hash_embedding(spark, sf_dir):
    from palimpsest.functions.embedding import embed_texts

    found = embed_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id", tokens=tokens(F.col("text")))
    return found.select("doc_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@query("RT-12_group_best", "SELECT label, max(round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6)) AS best FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) GROUP BY label")
def group_best(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return vectors.crossJoin(F.broadcast(q)).groupBy("label").agg(F.max(F.round(F.lit(1.0) - cosine_distance(F.col("embedding"), F.col("q")), 6)).alias("best"))


