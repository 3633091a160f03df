"""Searches that skip by bounds, and searches of many queries, against full scans."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators.nearest import nearest
from palimpsest.operators.postings import build_postings, open_postings, search_postings
from palimpsest.operators.retrieval import search_all


def _texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    text = lambda: " ".join(r.choices(words, [1 / (i + 1) for i in range(200)], k=int(r.lognormvariate(3, 1))))
    return [(i, None if i == 7 else "" if i == 8 else "same words here" if i % 5 == 0 else text()) for i in range(n)]


def _tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def _bm25(docs, query, top):
    sized = {k: _tokens(t) for k, t in docs}
    mean = sum(map(len, sized.values())) / len(sized)
    out = {}
    for word in set(_tokens(query)):
        has = {k: t.count(word) for k, t in sized.items() if word in t}
        idf = math.log(1 + (len(sized) - len(has) + 0.5) / (len(has) + 0.5))
        for k, f in has.items():
            out[k] = out.get(k, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(sized[k]) / mean))
    return sorted(((round(-s, 6), k) for k, s in out.items()))[:top]


def test_bm25_from_postings_is_the_full_scan(spark):
    docs, asked = _texts(900, 1), [(1, "w3 w90 w150"), (2, "here"), (3, "nowhere"), (4, None), (5, "w0 w1 W1 w2 same"), (6, "w199")]
    index = build_postings(spark.createDataFrame(docs, "doc_id long, text string"), key="doc_id", text="text", per_shard=32)
    for known in (index, open_postings(spark, index.path)):
        found, counts = search_postings(known, spark.createDataFrame(asked, "q_id long, query string"), top=5, key="doc_id")
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.q_id, r.place)):
            got.setdefault(r.q_id, []).append((-r.score, r.doc_id))
        for q, text in asked:
            assert [(pytest.approx(s, abs=2e-6), k) for s, k in _bm25(docs, text, 5)] == got.get(q, [])
        read = {r.q_id: (r.postings, r.read) for r in counts.collect()}
    assert set(read) == {1, 2, 5, 6} and read[2] == (180, read[2][1]) and read[1][1] < 0.7 * read[1][0]


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x")], "q_id long, query string")
    assert search_postings(build_postings(none, key="doc_id", text="text"), asked, top=3)[0].count() == 0
    assert search_postings(build_postings(asked.toDF("doc_id", "text"), key="doc_id", text="text"), asked.where("false"), top=3)[0].count() == 0


def _near(rows, queries, top):
    fine = [(k, np.array(v) / np.linalg.norm(v)) for k, v in rows if v and any(v)]
    out = []
    for k, q in fine:
        if k in queries:
            out += [(k, j, d) for d, j in sorted((round(1 - float(q @ x), 6), j) for j, x in fine if j != k)[:top]]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_by_pivots_is_the_full_scan(spark, clustered):
    r = random.Random(3)
    middle = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    row = lambda: [x + r.gauss(0, 0.05) for x in r.choice(middle)] if clustered else [r.gauss(0, 1) for _ in range(12)]
    rows = [(i, row()) for i in range(1500)] + [(1500 + i, [1.0] * 12) for i in range(500)] + [(3000, None), (3001, [0.0] * 12), (3002, [0.0, 1.0] * 6)]
    queries = {i for i, _ in rows if i % 50 == 0}
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    found, counts = nearest(df.where("id % 50 = 0"), df, key="id", vector="v", top=4, block_bytes=1 << 14, counts=True)
    wanted = _near(rows, queries, 4)
    got = [tuple(x) for x in found.orderBy("q_id", "distance", "id").collect()]
    # Distances a rounding apart may trade places with numpy's other order of sums.
    assert [(q, d) for q, _, d in got] == [(q, pytest.approx(d, abs=2e-6)) for q, _, d in sorted(wanted, key=lambda x: (x[0], x[2], x[1]))]
    assert len({(q, k) for q, k, _ in got} & {(q, k) for q, k, _ in wanted}) >= 0.99 * len(wanted)
    pairs, met = counts.first()
    assert pairs == len(queries - {3000}) * 2001 and (met < 0.6 * pairs if clustered else met <= pairs)


@pytest.mark.parametrize("mode", ["hybrid", "lexical"])
def test_search_of_many_queries_with_titles_recency_and_groups(spark, mode):
    from palimpsest.functions.text import trigrams

    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "one", "two"]
    items = [(i, " ".join(r.choices(words, k=r.randrange(4))), " ".join(r.choices(words, k=2)), r.choice([None, 1, 2, 3]), i % 3 if i % 7 else None) for i in range(120)]
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(0, 120, 2) for _ in range(1 + i % 3)]
    queries = [(100 + i, " ".join(r.choices(words + ["zeta"], k=1 + i * 20)), [1.0, 0.5, 0.0, 0.0] if i % 2 else None, i % 3 if i else None) for i in range(6)]
    x = spark.createDataFrame(items, "id long, text string, title string, day int, g int").repartition(3)
    grams = {row.t: set(row.g) for row in spark.createDataFrame([(t,) for t in {i[2] for i in items} | {q[1] for q in queries}], "t string").select("t", trigrams(F.lower("t")).alias("g")).collect()}
    wanted = []
    for q, text, v, g in queries:
        asked, ranked = set(_tokens(text)), []
        for k, t, title, day, group in items:
            if group != g:
                continue
            a, b = grams[title], grams[text]
            lexical = round(max(len(asked & set(_tokens(t))) / len(asked), len(a & b) / len(a | b) if a | b else 0), 6)
            near = [np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) for j, w in vectors if j == k] if v else []
            near = round(float(max(near)), 6) if near else 0.0
            score = round(lexical * (0.45 if mode == "hybrid" else 1) + near * (0.55 if mode == "hybrid" else 0), 8)
            ranked.append((-score, day is not None, -(day or 0), k))
        wanted += [(q, k, -s) for s, _, _, k in sorted(ranked)[:5]]
    found = search_all(
        spark.createDataFrame(queries, "q_id long, query string, vector array<double>, g int"), x, spark.createDataFrame(vectors, "vec_id long, embedding array<double>"),
        key="id", text="text", mode=mode, title="title", published="day", group="g", top=5, block_bytes=1500)
    assert sorted((r.q_id, r.id, r.score) for r in found.collect()) == sorted((q, k, pytest.approx(s, abs=1e-6)) for q, k, s in wanted)
