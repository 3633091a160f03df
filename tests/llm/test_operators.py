"""Methods of the operators in detail: plans, scores by brute force, bounds of samples and sets, crowded groups."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, language_id, line_dedup, quality_classifier, quality_rules, queries, scan

SF = "/root/testdata/sf0.001"


def _block(*texts):
    return scan.utf8(pa.array(texts, pa.large_string()))


def _thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_lines_and_words_that_polynomial_hashes_confuse(n):
    line = _thue_morse(n)
    other = line.translate(str.maketrans("ab", "ba"))
    _, counts = quality_rules.count_block(*_block(f"{line}\n{other}", f"{line}\n{line}\n\n", line))
    assert counts["n_dup_lines"].tolist() == [0, 1, 0]
    words = scan.Words(*_block(f"{line} {other} {line}"), scan.class_table(b" ", False))
    h = words.hashes()
    assert h[0] != h[1] and h[0] == h[2]


def test_quality_rules_grams():
    words = scan.Words(*_block("ab ä€x ab ä€x", "", "ä€xy", "one"), scan.class_table(b" ", False))
    (uni, a, b), (two, c, d), (four, e, f) = quality_rules.features(words)
    assert (b - a).tolist() == [4, 0, 1, 1] and (d - c).tolist() == [3, 0, 0, 0] and (f - e).tolist() == [10, 0, 1, 0]
    assert uni[0] == uni[2] and uni[1] == uni[3] != uni[0] and two[0] == two[2] != two[1]
    assert four[0] == four[7] and len(set(four[:10].tolist())) == 7


def test_quality_rules_score_is_the_dense_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality_rules.fit_quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs, model).collect()}
    for r in docs.collect():
        families = quality_rules.features(scan.Words(*_block(r.text), scan.class_table(b" \t\n\x0b\x0c\r", False)))
        x = np.zeros(quality_rules.BINS)
        for bins, starts, stops in families:
            for i in bins[starts[0] : stops[0]]:
                x[i] += 1 / (stops[0] - starts[0])
        p = 1 / (1 + np.exp(-(model.slope * (x @ model.weights + model.bias) + model.shift)))
        assert abs(got[r.doc_id].score - p) < 1e-9
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and got[r.doc_id].score >= quality_rules.KEEP)


def test_quality_rules_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_quality_rules(spark, sf).join(labels, "doc_id").where("crc32(CAST(doc_id AS STRING)) % 5 = 0 AND NOT base_failed")
    right, n = rows.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 50 and right / n >= 0.95


def test_quality_classifier_is_the_dense_density(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit_quality_classifier(docs, labels)
    known = {r.doc_id: r.quality for r in labels.where("crc32(CAST(doc_id AS STRING)) % 5 <> 0").collect()}
    x = {r.doc_id: quality_classifier.statistics(*_block(r.text))[0] for r in docs.collect()}
    parts = [np.array([x[d] for d, q in sorted(known.items()) if q == c and d in x]) for c in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    n = [len(p) for p in parts]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    target = 0.8 * pooled + 0.2 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
    full = [0.8 * c + 0.2 * target for c in cov]
    for r in quality_classifier.score_quality(docs, model).collect():
        density = [-0.5 * (x[r.doc_id] - p.mean(0)) @ np.linalg.solve(c, x[r.doc_id] - p.mean(0)) - 0.5 * np.linalg.slogdet(c)[1] for p, c in zip(parts, full)]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 4, -500, 500)))) < 1e-6


def test_language_score_is_the_plain_softmax(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit_language_model(docs)
    for r, t in zip(language_id.identify_language(docs, model).collect(), docs.collect()):
        bins, _ = language_id.subwords(*_block(t.text))
        z = (np.mean([model.scores[i].astype(float) for i in bins], axis=0) if len(bins) else 0) + model.bias
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        if r.lang_pred != "und":
            assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-4


def test_samples_of_long_texts_only(spark):
    rng = random.Random(2)
    prose = {"en": "the cat sat with an old hat and then ran".split(), "de": "die katze und der hund gehen nach hause zum".split()}
    text = lambda lang: " ".join(rng.choice(prose[lang]) for _ in range(2000))
    rows = [(i, text(lang), lang, int(lang == "en")) for i in range(120) for lang in ("en", "de")]
    docs = spark.createDataFrame([(2 * i + (lang == "de"), t, lang, q) for i, t, lang, q in rows], "doc_id long, text string, lang string, quality int").cache()
    assert min(len(r[1]) for r in rows) > 4096
    model = language_id.fit_language_model(docs)
    assert language_id.identify_language(docs, model).where("lang_pred <> lang").count() == 0
    assert quality_rules.fit_quality_rules(docs, docs.select("doc_id", "quality")) is not None
    from palimpsest.llm.labels import sample_of, sample_with

    few = sample_of(docs, F.col("lang"), text="text", doc_id="doc_id", limit=100, budget=60_000)
    assert 0 < sum(len(t) for t, _ in few) <= 60_000
    assert 0 < len(sample_with(docs, docs.select("doc_id", "quality"), "quality", text="text", doc_id="doc_id", limit=7, budget=1 << 20)) <= 7
    one_id = docs.withColumn("doc_id", F.lit(2).cast("long"))
    assert 0 < len(sample_of(one_id, F.col("lang"), text="text", doc_id="doc_id", limit=60, budget=1 << 22)) <= 60


def test_near_lines_alone_are_counted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = line_dedup._keyed(docs, "text", "source", "doc_id")
    sites = collections.defaultdict(set)
    for r in docs.select("text", "source").collect():
        for line in r.text.split("\n"):
            if line.strip(" \t\r") and r.source is not None:
                sites[line.strip(" \t\r")].add(r.source)
    found = line_dedup._spread(lines, min_sites=3).count()
    assert found == sum(len(x) >= 3 for x in sites.values())


def test_long_line_and_hot_line(spark):
    long = "x" * 3_000_000
    rows = [(i, f"hot\n{long if i < 2 else i}\nhot", f"s{i % 8}") for i in range(200)]
    got = {r.doc_id: r for r in line_dedup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].n_removed == 0 and got[1].text == long and all(got[i].text == str(i) for i in range(2, 200))


def test_windows_of_a_large_benchmark_stay_small():
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, 2 << 20).astype(np.uint8)
    letters[rng.random(len(letters)) < 0.25] = 32
    items = [(str(i), letters[i * 65536 : (i + 1) * 65536].tobytes().decode()) for i in range(32)]
    made = decontamination.WindowSet(items, 10)
    size = sum(x.nbytes for t in made.tables.values() for x in t[:3]) + sum(t[4].nbytes for t in made.tables.values())
    assert size < 12 * (2 << 20)
    doc = "zz " + " ".join(items[5][1].split()[100:112])
    words = decontamination._words(*_block(doc))
    assert {(at, tuple(names)) for at, _, names in made.hits(words, scan.Rolling(words.hashes()))} == {(1, ("5",)), (2, ("5",)), (3, ("5",))}


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(scan, "mix", lambda h: h * np.uint64(0) + np.uint64(7))
    items = [("a", "x y z"), ("b", "p q r"), ("c", "x y z"), ("d", "u v w")]
    made = decontamination.WindowSet(items, 3)
    words = decontamination._words(*_block("p q r x y z"))
    assert {(at, tuple(names)) for at, _, names in made.hits(words, scan.Rolling(words.hashes()))} == {(0, ("b",)), (3, ("a", "c"))}


def test_long_transcript_and_tied_paths(spark):
    from palimpsest.llm import chat

    even = chat.fit(np.zeros(6), np.zeros((6, 6)), [np.zeros((6, s)) for s in chat.SIZES])
    plain = [(0, 0 if not i else 1, 0, 0, 3, 0) for i in range(5)]
    assert [chat.STATES[s] for s in even.decode(plain)] == [("system", True)] + [("system", False)] * 4  # of equal roles the first
    text = "\n\n".join(f"{'User' if i % 2 == 0 else 'Assistant'}: line {i}" for i in range(4000))
    row = chat.format_chats(spark.createDataFrame([(text,)], "transcript string"), even).first()
    assert row.n_turns == 4000 and [t.role for t in row.turns] == ["user", "assistant"] * 2000


def test_scores_at_the_threshold_count(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    model = quality_classifier.Model(None, None, None, 0.3)
    assert {r.predicted for r in quality_classifier.score_quality(docs, model).collect()} == {1}
    flat = quality_rules.Model(np.zeros(quality_rules.BINS, np.float32), 0.0)
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert quality_rules.apply_quality_rules(long, flat, keep=0.5).first().kept and not quality_rules.apply_quality_rules(long, flat, keep=0.5001).first().kept
