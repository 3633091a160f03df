"""What the review of round 4 found."""

import random
import re
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval


def test_copies_of_asking_blocks_pass_no_driver(spark, monkeypatch):
    plans, real = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    items = spark.range(60).select("id", F.concat(F.lit("item "), F.col("id") % 3).alias("text"), (F.col("id") % 2).alias("g"))
    vectors = spark.range(0, 60, 4).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 60).alias("embedding"))
    asked = spark.range(5).select(F.col("id").alias("q_id"), F.lit("item 1").alias("query"), F.array(F.lit(0.5), F.lit(1.0)).alias("vector"), (F.col("id") % 3).alias("g"))
    rows = retrieval.search_all(asked, items, vectors, key="id", text="text", group="g", top=3).collect()
    assert len(rows) == 4 * 3 and all(r.id % 2 == r.q_id % 3 for r in rows)  # a group without items finds none
    met = [p for p in plans if re.search(r"Join \[.*q_group.*salt", p)]
    assert met and not any(re.search(r"BroadcastHashJoin \[.*q_group.*salt", p) for p in met)


@pytest.mark.parametrize("mode", ["hybrid", "lexical"])
def test_items_that_cannot_reach_a_querys_bar_are_not_scored(spark, monkeypatch, mode):
    rng = random.Random(4)
    monkeypatch.setattr(retrieval, "LARGEST", 40)
    words = [f"w{i}" for i in range(400)]
    rare = lambda: words[min(399, int(rng.paretovariate(0.5)))]
    texts = {i: " ".join(rare() for _ in range(rng.choice([0, 3, 20, 60, 200]))) for i in range(600)} | {600: None, 601: "only here", 602: "only here"}
    vectors = {i: [[rng.gauss(0, 1) for _ in range(4)] for _ in range(1 + i % 2)] for i in range(0, 600, 7)}
    days = {i: i % 5 or None for i in texts}
    docs = spark.createDataFrame([(i, t, days[i]) for i, t in texts.items()], "doc_id long, text string, day int")
    rows = spark.createDataFrame([(i, v) for i, of in vectors.items() for v in of], "vec_id long, embedding array<double>")
    asked = {i: (texts[i], vectors[i][0] if i in vectors else None) for i in [*range(0, 600, 25), 600, 601]} | {700: ("unknown words", None), 701: ("unknown words", [1.0, 0.0, 0.0, 0.0])}
    queries = spark.createDataFrame([(q, *x) for q, x in asked.items()], "q_id long, query string, vector array<double>")
    got = sorted(map(tuple, retrieval.search_all(queries, docs, rows, key="doc_id", text="text", published="day", mode=mode, top=6).collect()))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want, weights = [], retrieval.WEIGHTS[mode]
    for q, (text, v) in asked.items():
        terms, scored = set((text or "").split()), []
        for i, t in texts.items():
            lexical = float(retrieval._half_up(np.float64(len(terms & set((t or "").split())) / max(len(terms), 1)), 6))
            near = round(max((float(unit(v) @ unit(x)) for x in vectors[i]), default=0.0), 6) if v and i in vectors else 0.0
            scored.append((-round(lexical * weights[0] + near * weights[1], 8), days[i] is not None, -(days[i] or 0), i, lexical, near))
        want += [(q, i, lexical, near, -score) for score, _, _, i, lexical, near in sorted(scored)[:6]]
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in sorted(want)], atol=1e-9)


def test_few_pairs_are_compared_by_all_their_tokens(spark):
    """Of 300 items that have two of a query's three tokens, one has the third."""
    import pyarrow as pa

    terms = [[1, 2, 100 + i] for i in range(300)]
    items = pa.array([{"id": i, "terms": t, "v": [], "first": False, "age": None} for i, t in enumerate(terms)], pa.struct([("id", pa.int64()), ("terms", pa.list_(pa.int64())), ("v", pa.list_(pa.list_(pa.float64()))), ("first", pa.bool_()), ("age", pa.float64())]))
    asked = pa.array([{"q_id": i, "terms": [1, 2, 100 + i], "v": [], "bar": 0.9} for i in range(30)], pa.struct([("q_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("v", pa.list_(pa.list_(pa.float64()))), ("bar", pa.float64())]))
    block = retrieval._Asked(asked, (1.0, 0.0))
    row, column, lexical, _, _ = retrieval._reaching(block, items, (1.0, 0.0))
    assert list(row) == list(column) == list(range(30)) and set(lexical) == {1.0}
    # Each query looks one of the tokens up that all have in common, at most.
    assert block.n_rare.max() <= 2 and block.times.sum() <= 60


@pytest.mark.parametrize("page,error,items", [
    ('<ul><li><a href="/a">A\n  <b>b</b></a></li><li><a href="http://y.org/c">C</a></li></ul>', None, [(1, "http://x.org/a", "A b"), (2, "http://y.org/c", "C")]),
    ('<ul><li><a href="/a">A</a><ul><li><a href="b">B</a></li></ul></li></ul>', None, [(1, "http://x.org/a", "A"), (2, "http://x.org/p/b", "B")]),
    ('<li><a href="/a">A</a><li><a href="/b">B</a> <a href="/c">C</a>', "list row 2 link: expected 1 element, found 2", []),
    ('<ul><li><ul><li><a href="/b">B</a></li></ul></li></ul>', "list row 1 link: expected 1 element, found 0", []),
    ('<li><a href="/a">A</a><li><a href="#top">B</a>', "list row 2: href missing or not HTTP(S)", []),
    ('<li><a href="javascript:go()">A</a>', "list row 1: href missing or not HTTP(S)", []),
    ('<li><a href="http://[bad">A</a>', "list row 1: href missing or not HTTP(S)", []),
    ('<li><a href="/a"><img src="a.png"></a>', "list row 1: empty title", []),
    ("<p>no list</p>", "no list", []),
    (None, "no list", []),
])
def test_items_of_a_list_are_judged_as_strictly_as_by_the_reference(spark, tmp_path, page, error, items):
    from palimpsest.plans import registry

    spark.createDataFrame([(7, "http://x.org/p/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = registry.queries()["DOC-04_list_items"](spark, str(tmp_path)).first()
    assert (row.page_id, row.ok, row.error, row.n_items, [tuple(x) for x in row["items"]]) == (7, error is None, error, len(items), items)


def test_queries_without_a_vector_meet_the_first_items_only(spark, monkeypatch):
    sizes, real = {}, retrieval.packed

    def counted(df, name, **options):
        sizes.update({name: sizes.get(name, []) + [(r.in_group.zero, r["count"]) for r in df.groupBy("in_group").count().collect()]})
        return real(df, name, **options)

    monkeypatch.setattr(retrieval, "packed", counted)
    docs = spark.range(300).select("id", F.concat(F.lit("item "), F.col("id")).alias("text"), F.when(F.col("id") % 9 > 0, F.col("id") % 4).alias("day"))
    vectors = spark.range(0, 300, 3).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 100 - 1).alias("embedding"))
    asked = spark.createDataFrame([(1, "item 18", None), (2, "item 7", None), (3, "item 9", [1.0, -1.0]), (4, "item", [-1.0, 0.0]), (5, "item", None), (5, "item", [1.0, 0.0])], "q_id long, query string, vector array<double>")
    got = {q: [(r.id, r.lexical, r.vector) for r in rows] for q, rows in groupby(retrieval.search_all(
        asked, docs, vectors, key="id", text="text", published="day", mode="vector", top=4).orderBy("q_id", F.desc("score"), "id").collect(), lambda r: r.q_id)}
    assert got[1] == [(0, 0.5, 0.0), (9, 0.5, 0.0), (18, 1.0, 0.0), (27, 0.5, 0.0)]
    assert [r[0] for r in got[2]] == [0, 9, 18, 27] and [r[0] for r in got[3]] == [0, 3, 6, 9]
    # All vectors are behind the items without one.
    assert [r[0] for r in got[4]] == [7, 11, 19, 23] and all(r[2] == 0 for r in got[4])
    assert [r[0] for r in got[5]] == [99, 102, 96, 105]
    assert sorted(sizes["x"]) == [(False, 100 + 4), (True, 4)] and sorted(sizes["q"]) == [(False, 3), (True, 3)]
