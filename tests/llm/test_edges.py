"""Every operator on nulls, empty tables and texts, repeated rows, ties and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, decontamination, language_id, line_dedup, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup

WORDS = " ".join(f"word{i}" for i in range(70))
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `n_words` string, `a.b` int, `__text` string, SCORE string"
ROWS = [
    (1, WORDS, "en", "a", 1, "x", 1, "t", "s"), (2, WORDS + " tail", "en", "b", 2, "x", 2, "t", "s"), (2, WORDS + " tail", "en", "b", 2, "x", 2, "t", "s"),
    (3, None, None, None, None, None, None, None, None), (4, "", "de", "a", 0, "x", 4, "t", "s"), (None, WORDS, "en", "c", 5, "x", 5, "t", "s"),
    (5, "  \n \t ", "de", None, 6, "x", 6, "t", "s"), (6, LONG, "en", "a", 7, "x", 7, "t", "s"), (7, "42 !!", "en", "a", 7, "x", 7, "t", "s"), (2, "other text", "de", "b", 1, "x", 1, "t", "s"),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (None, 1, 0), (6, None, 1), (7, 0, 0)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "word1 word2 word3"), (2, None), (3, ""), (None, "w0x0 w1x0"), (4, "word1 word2 word3")], "item_id long, text string")


def _empty(df):
    return df.where("false")


def test_substring_dedup(docs):
    rows = substring_dedup.remove_repeated_windows(docs).collect()
    assert len(rows) == len(ROWS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in rows)
    assert (False, 1, 70, 0) in got and got.count((False, 2, 71, 70)) == 2 and (True, 0, 70, 70) in got and (False, 3, 0, 0) in got and (False, 6, 40_000, 0) in got
    assert substring_dedup.remove_repeated_windows(_empty(docs)).count() == 0


def test_suffix_dedup(docs):
    rows = suffix_dedup.remove_repeated_strings(docs).collect()
    size = len(WORDS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in rows)
    assert len(rows) == len(ROWS) and (False, 1, size, size, 1) in got and (True, 0, size, size, 1) in got and got.count((False, 2, size + 5, size + 5, 1)) == 2
    assert (False, 3, 0, 0, 0) in got and suffix_dedup.remove_repeated_strings(_empty(docs)).count() == 0


def test_line_dedup(docs):
    rows = line_dedup.remove_spread_lines(docs, min_sites=2).collect()
    assert len(rows) == len(ROWS) and {r.n_removed for r in rows if r.doc_id is None} == {1}
    assert all(r.n_removed == 0 for r in rows if r.doc_id == 1) and [r.n_lines for r in rows if r.doc_id == 3] == [0]
    assert line_dedup.remove_spread_lines(_empty(docs)).count() == 0


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    zero = {r.doc_id: r for r in rows if r.fingerprint == 0}
    assert {3, 4, 5} <= set(zero) and {r.component_id for r in zero.values()} == {3}
    assert [r.component_id for r in rows if r.doc_id is None] == [1]
    kept = simhash.drop_near_duplicates(docs).collect()
    # 1 stands for its copy without an id and for the text that is two bits away; 3 stands for the empty texts.
    assert [r.text for r in kept if r.doc_id == 2] == ["other text"]
    assert {r.doc_id for r in kept} >= {1, 3, 6, 7} and kept[0].asDict().keys() == set(docs.columns)
    assert simhash.near_duplicates(_empty(docs)).count() == 0 and simhash.drop_near_duplicates(_empty(docs)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "Hello\n\nthere"), (None, 0, "user", "alone"), (2, 0, None, "x"), (3, 0, "user", None), (1, 1, "assistant", "Hello\n\nthere"), (4, 0, "user", "  ")]
    known = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    model = chat.fit_chat_model(known)
    rows = chat.format_chats(known.withColumn("n_turns", F.lit("clash")), model).collect()
    assert {r.conv_id for r in rows} == {1, 2, None} and all(r.n_turns >= 1 for r in rows)
    none = chat.format_chats(spark.createDataFrame([(None,), ("",), (" \n ",)], "transcript string"), model).collect()
    assert [(r.n_turns, r.rendered) for r in none] == [(0, "")] * 3
    assert chat.format_chats(_empty(known), chat.fit_chat_model(_empty(known))).count() == 0


def test_quality_classifier(docs, labels):
    model = quality_classifier.fit_quality_classifier(docs, labels)
    rows = quality_classifier.score_quality(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    unlearned = quality_classifier.fit_quality_classifier(_empty(docs), _empty(labels))
    assert {r.predicted for r in quality_classifier.score_quality(docs, unlearned).collect()} == {1}


def test_decontamination(docs, benchmark):
    rows = decontamination.find_contamination(docs, benchmark).collect()
    hits = {(r.doc_id, tuple(r["items"])) for r in rows if r.hit_words}
    assert hits == {(1, ("1", "4")), (2, ("1", "4")), (None, ("1", "4")), (6, ())} and len(rows) == len(ROWS)
    clean = decontamination.remove_contamination(docs, benchmark).collect()
    assert all("word1 word2 word3" not in (r.text or "") for r in clean) and len(clean) == len(ROWS) and set(clean[0].asDict()) == set(docs.columns)
    assert decontamination.find_contamination(docs, _empty(benchmark)).where(F.size("hit_words") > 0).count() == 0


def test_decontamination_in_blocks(docs, benchmark):
    key = lambda r: (str(r.doc_id), r.text or "", tuple(r.hit_starts), tuple(r.hit_ends), tuple(r.hit_from), tuple(r.hit_words), tuple(r["items"]))
    whole = sorted(map(key, decontamination.find_contamination(docs, benchmark, n=2).collect()))
    parts = sorted(map(key, decontamination.find_contamination(docs, benchmark, n=2, block_bytes=20).collect()))
    assert whole == parts


def test_quality_rules(docs, labels):
    model = quality_rules.fit_quality_rules(docs, labels)
    rows = quality_rules.apply_quality_rules(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 5, 7))
    assert quality_rules.fit_quality_rules(_empty(docs), labels) is None


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    assert sorted(r.taken for r in rows) == sorted(r.taken for r in mixing.mix(docs.repartition(3)).collect())
    emitted = mixing.emit(docs.withColumn("Copy", F.lit(9)))
    assert emitted.count() == sum(r.copies for r in rows) and "copy" in emitted.columns and "Copy" not in emitted.columns
    assert mixing.mix(_empty(docs)).count() == 0 and mixing.emit(_empty(docs)).count() == 0


def test_language(docs):
    model = language_id.fit_language_model(docs)
    rows = language_id.identify_language(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 7))
    assert {r.lang_pred for r in language_id.identify_language(docs, language_id.fit_language_model(_empty(docs))).collect()} == {"und"}


def test_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (docs, _empty(docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert set(out.columns) - {"copy"} == set(docs.columns), name
            out.write.format("noop").mode("overwrite").save()
