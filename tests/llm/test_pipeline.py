"""The whole pipeline against brute force of its stages, one after another."""

import collections
import hashlib
import math
import re

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import quality_classifier
from tests.llm.test_similar import _least

SF = "/root/testdata/sf0.001"


def _without_spread_lines(docs):
    sites, first = collections.defaultdict(set), {}
    for d, (text, source) in sorted(docs.items()):
        for line in text.split("\n"):
            if key := line.strip(" \t\r"):
                sites[key].add(source)
                first.setdefault(key, d)
    out = {}
    for d, (text, source) in docs.items():
        kept = [x for x in text.split("\n") if len(sites[x.strip(" \t\r")] - {None}) < 8 or first[x.strip(" \t\r")] == d]
        if len(kept) == text.count("\n") + 1 or "\n".join(kept).strip(" "):
            out[d] = ("\n".join(kept), source)
    return out


def _clean(text, windows):
    raw = text.encode()
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    hit = set()
    for size, known in windows.items():
        for i in range(len(words) - size + 1):
            if tuple(w for _, _, w in words[i : i + size]) in known:
                hit |= set(range(i, i + size))
    if 2 * len(hit) > len(words):
        return None
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(raw[at : words[i][0]])
        at = words[i][1]
    return b"\n".join([*out, raw[at:]]).decode() if hit else text


def _mixed(docs):
    size = {d: len(text.encode().split()) for d, (text, _) in docs.items()}
    by = collections.defaultdict(list)
    for d, (_, source) in docs.items():
        by[source].append(d)
    names = sorted(by, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held = {}
    while True:
        free = [s for s in names if s not in held]
        level = (sum(total.values()) - sum(held.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * total[s]]
        if not over:
            break
        held |= {s: 3 * total[s] for s in over}
    out = collections.Counter()
    for s in names:
        rate = (held[s] if s in held else weight[s] * level) / total[s] if total[s] else 0
        u = int(hashlib.md5(("mix" + (f":{s}" if s is not None else "")).encode()).hexdigest()[:8], 16) / 2**32
        for i, d in enumerate(sorted(by[s], key=lambda d: (size[d], d)), 1):
            for copy in range(min(3, math.floor(rate * i + u) - math.floor(rate * (i - 1) + u))):
                out[(d, docs[d][0], copy + 1)] += 1
    return out


def test_run_is_its_stages(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit_quality_classifier(documents, labels)
    good = quality_classifier.score_quality(documents, model).where("predicted = 1")
    docs = _without_spread_lines({r.doc_id: (r.text, r.source) for r in good.collect()})
    least = _least({d: t for d, (t, _) in docs.items()})
    docs = {d: x for d, x in docs.items() if least[d] == d}
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower())
        n = min(10, len(words))
        windows[n] |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    cleaned = {d: (_clean(t, windows), s) for d, (t, s) in docs.items()}
    want = _mixed({d: x for d, x in cleaned.items() if x[0] is not None})
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) == {*documents.columns, "copy"} and rows.where(F.char_length("text") != F.col("n_chars")).isEmpty()
    assert collections.Counter((r.doc_id, r.text, r.copy) for r in rows.collect()) == want and sum(want.values()) > 100


def test_first_stage_alone_reads_the_documents(spark):
    files = corpus_pipeline.run(spark, SF).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
