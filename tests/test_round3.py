"""What the review of round 3 found: work that has to grow no faster than the input."""

import itertools

from pyspark.sql import functions as F

from palimpsest.operators import similarity


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_crowded_name_are_expanded_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PIECE", 8)
    names = {i: ("red ring", "red rings", "blue bolt", "", None)[i % 5] for i in range(200)}
    got = similarity.trigram_pairs(spark.createDataFrame(list(names.items()), "k long, n string"), key="k", name="n", at_least=0.5, digits=3)
    value = lambda a, b: 1.0 if a == b else round(8 / 11, 3) if {a, b} == {"red ring", "red rings"} else None
    want = {(i, j, value(a, b)) for (i, a), (j, b) in itertools.combinations(names.items(), 2) if a and b and value(a, b)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    # From the top of the plan, keys are exploded before anything is shuffled.
    plan = _plan(got)
    assert plan.index("Generate explode(keysb") < plan.index("Exchange")


def test_near_duplicate_stage_links_by_fingerprints_and_pivots_first(spark, monkeypatch):
    import corpus_pipeline
    from palimpsest.llm import shingle_dedup

    met = []
    real = shingle_dedup.near_prints
    monkeypatch.setattr(shingle_dedup, "near_prints", lambda prints, **options: met.append(prints.count()) or real(prints, **options))
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words)), "two words", "two words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2, 3, 5} and met and met[0] >= 3


def test_a_mode_of_vectors_alone_compares_no_words(spark, monkeypatch):
    from palimpsest.operators import retrieval

    docs = spark.createDataFrame([(i, f"red ring {i}" if i else "red ring") for i in range(80)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in (0, 3, 5)] + [(7, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, "red ring", [1.0, 0.0])], "q_id long, query string, vector array<double>")
    rows = retrieval.search_all(asked, docs, vectors, key="doc_id", text="text", mode="vector", top=6).orderBy("q_id", F.desc("score"), "doc_id").collect()
    assert [(r.doc_id, r.lexical, r.vector) for r in rows] == [(0, 1.0, 1.0), (3, 1.0, 0.957826), (5, 1.0, 0.894427), (1, 1.0, 0.0), (2, 1.0, 0.0), (4, 1.0, 0.0)]
    # A share of 1/128 is rounded as in SQL.
    many = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(128)), [1.0, 0.0])], "q_id long, query string, vector array<double>")
    one = spark.createDataFrame([(1, "w5")], "doc_id long, text string")
    for mode in ("hybrid", "lexical", "vector"):
        assert retrieval.search_all(many, one, vectors, key="doc_id", text="text", mode=mode).first()["lexical"] == 0.007813


def test_whole_texts_go_to_python_in_small_batches(spark):
    from palimpsest.operators.packing import TEXT_ROWS
    from palimpsest.plans import registry

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query in ("DOC-04_list_items", "DOC-06_rendered_text", "DOC-08_revision_signals", "SC-10_quote_offsets"):
            spark.conf.set(name, 10_000)
            registry.queries()[query](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(name)) == TEXT_ROWS
    finally:
        spark.conf.set(name, before)
