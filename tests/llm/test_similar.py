"""The near-duplicate stage against brute-force Jaccard."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import shingle_dedup

SF = "/root/testdata/sf0.001"


def _set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _least(texts):
    """The least id that each id is connected to."""
    sets, root = {d: _set(t) for d, t in texts.items()}, {d: d for d in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def _edited(text, every, rng):
    w = text.split()
    for i in range(rng.randrange(every), len(w), every):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def _corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    bases = [" ".join(word() for _ in range(rng.choice((6, 40, 150, 400)))) for _ in range(12)]
    notice = " ".join(word() for _ in range(60))
    texts = bases + [_edited(t, e, rng) for t in bases for e in (20, 44, 46, 50, 70, 150)]
    texts += [_edited(bases[0] + " " + notice, e, rng) for e in range(40, 90)] + [notice + " " + " ".join(word() for _ in range(10)) for _ in range(40)]
    return dict(enumerate(texts + [None, "", " ", "Two Words", "two words", "two"], 1))


def test_stage_links_all_similar_documents(spark):
    texts = _corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    want = set(_least(texts).values())
    assert got == want and len(want) < len(texts) - 30


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set(_least({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}).values())
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_tallies_never_part_similar_sets(spark):
    """The bound on tallies holds for every pair that reaches the coefficient, and parts most others."""
    import numpy as np
    import pyarrow as pa

    texts = list(_corpus().values())
    h, bounds = shingle_dedup.shingle_sets(pa.array(texts, pa.string()))
    tally = np.array(shingle_dedup._tallies(h, bounds).to_pylist())
    sets = [set(h[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    parted = others = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        apart = np.abs(tally[i] - tally[j]).sum() * 1.8 > 0.2 * (len(sets[i]) + len(sets[j])) + 1e-6
        similar = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        assert not (similar and apart)
        parted, others = parted + apart, others + (not similar)
    assert parted > 0.9 * others


@pytest.mark.parametrize("bucket,centres,common", [(16, 4, 1 << 19), (2, 1, 0), (2, 1, 50)])
def test_bounds_lose_no_link(spark, monkeypatch, bucket, centres, common):
    for name, value in {"BUCKET": bucket, "CENTRES": centres, "COMMON": common, "BLOCK": 3, "SAMPLE": 1}.items():
        monkeypatch.setattr(shingle_dedup, name, value)
    texts = _corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = shingle_dedup.similar_documents(docs)
    got = found.withColumn("least", F.expr("min(doc_id) OVER (PARTITION BY component)")).collect()
    assert {r.doc_id: r.least for r in got} == _least(texts)
