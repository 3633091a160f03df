"""A passage that very many different texts share: op10 and the near-duplicate stage keep no hot group in one task."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import shingle_dedup, simhash, suffix_dedup


def _texts(count, passage, rng):
    word = lambda: f"{rng.randrange(10**9):x}"
    return {i: " ".join(word() for _ in range(30)) + passage + " ".join(word() for _ in range(30)) for i in range(1, count + 1)}


def _removed(texts, n):
    """How many bytes of each text lie in an n-byte string that starts twice, by brute force."""
    seen = {}
    data = {d: t.encode() for d, t in texts.items()}
    for b in data.values():
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    gone = {}
    for d, b in data.items():
        hit = set()
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                hit.update(range(i, i + n))
        gone[d] = len(hit)
    return gone


def _corpus(count=1500):
    rng = random.Random(3)
    passage = " ".join(f"{rng.randrange(10**9):x}" for _ in range(60))[:420]
    texts = _texts(count, passage, rng)
    # Two kinds of neighbours of the same passage, an exact copy, and a text that repeats it.
    tails = [f" tail {i} of some more bytes that only a few of the texts have in common with others" for i in range(20)]
    texts |= {count + i: texts[i][:200] + passage + tails[i % 20] for i in range(1, 101)}
    return texts | {5000: texts[7], 5001: passage + " and " + passage}


def test_suffix_dedup_of_a_shared_passage(spark):
    texts = _corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_strings(docs).select("doc_id", "n_removed").collect()}
    want = _removed(texts, 400)
    assert got == want and min(want.values()) >= 400


@pytest.mark.parametrize("count", [300, 1500])
def test_no_group_over_the_bound(spark, monkeypatch, count):
    """Every group of segments that a task builds has CROWD segments at most, however many texts share a passage."""
    sizes = []
    split, pairs = suffix_dedup._in_crowds, suffix_dedup._pairs
    largest = lambda x: x.groupBy("side", "group").count().agg(F.max("count")).first()[0] or 0

    def in_crowds(dealt):
        few, crowds = split(dealt)
        sizes.append((largest(few), largest(crowds)))
        return few, crowds

    def twos(twins, segments):
        found = pairs(twins, segments)
        sizes.append(largest(found))
        return found

    monkeypatch.setattr(suffix_dedup, "_in_crowds", in_crowds)
    monkeypatch.setattr(suffix_dedup, "_pairs", twos)
    docs = spark.createDataFrame(list(_corpus(count).items()), "doc_id long, text string")
    suffix_dedup.remove_repeated_strings(docs)
    (few, crowd), two = sizes
    assert few <= suffix_dedup.CROWD < crowd and two == 2


def _pages(count, own):
    """Templated pages: `own` words of each page's own in one sentence that all have in common."""
    sentence = [f"s{i}" for i in range(26)]
    pages = {}
    for i in range(1, count + 1):
        w = list(sentence)
        for j in range(own):
            w.insert(1 + 20 * j, f"o{i}x{j}")
        pages[i] = " ".join(w)
    return pages


def test_templated_pages_form_few_pairs(spark, monkeypatch):
    """2,400 pages that share a sentence and don't link: at most ten pairs a page are compared."""
    pairs = []
    first, across = shingle_dedup._first_pairs, shingle_dedup._across

    def counted(make):
        def run(*args):
            found = shingle_dedup.cut(make(*args))
            pairs.append(found.count())
            return found
        return run

    monkeypatch.setattr(shingle_dedup, "_first_pairs", counted(first))
    monkeypatch.setattr(shingle_dedup, "_across", counted(across))
    pages = _pages(2400, 2)
    found = shingle_dedup.similar_documents(spark.createDataFrame(list(pages.items()), "doc_id long, text string"))
    assert found.select("component").distinct().count() == len(pages)
    assert len(pairs) == 2 and pairs[1] == 0 and sum(pairs) <= 10 * len(pages)


def test_links_across_a_crowd_stay(spark, monkeypatch):
    """Pages of one template of which some link: by large postings alone, and by small ones before a large one."""
    for name, value in {"BUCKET": 4, "CENTRES": 1, "BLOCK": 8, "SAMPLE": 1}.items():
        monkeypatch.setattr(shingle_dedup, name, value)
    rng = random.Random(9)
    long = [f"t{i}" for i in range(60)]
    pages = {i: t for i, t in _pages(60, 2).items()}
    for i in range(100, 160):  # 5 to 15 of 60 shingles are replaced, by few words, so that the coefficient is near 0.8
        w = list(long)
        for place in rng.sample((3, 15, 27, 39, 51), rng.choice((1, 1, 2))):
            w[place] = f"v{rng.randrange(9)}"
        pages[i] = " ".join(w + [f"e{rng.randrange(30)}" for _ in range(rng.randrange(4))])
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t in pages.items()}
    root = {d: d for d in pages}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in pages:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    found = shingle_dedup.similar_documents(docs).withColumn("least", F.expr("min(doc_id) OVER (PARTITION BY component)")).collect()
    assert {r.doc_id: r.least for r in found} == root and len(set(root.values())) > 70


def test_links_at_the_bound_after_small_postings(spark, monkeypatch):
    """Pairs of a coefficient of exactly 0.8 in a crowd: `shared` shingles that only the two have, then the template's."""
    for name, value in {"BUCKET": 4, "CENTRES": 1, "BLOCK": 4, "SAMPLE": 1}.items():
        monkeypatch.setattr(shingle_dedup, name, value)
    pages, want = {}, {}
    for shared in range(4):
        template = [f"t{shared}x{i}" for i in range(28 - shared)]
        for pair in range(10):
            for side in range(2):
                key = 100 * shared + 2 * pair + side + 1
                own, both = [f"u{key}x{i}" for i in range(3)], [f"p{shared}x{pair}x{i}" for i in range(shared)]
                # With none that only two have, the template alone links all.
                pages[key], want[key] = " ".join(own + template + both), key - side if shared else 1
    docs = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    found = shingle_dedup.similar_documents(docs).withColumn("least", F.expr("min(doc_id) OVER (PARTITION BY component)")).collect()
    assert {r.doc_id: r.least for r in found} == want


def test_plans_of_the_stage_stay_small(spark, monkeypatch):
    """No step of the stage, which the driver plans and keeps, has over five joins, and slots make no row that isn't kept."""
    for name, value in {"BUCKET": 4, "CENTRES": 1, "BLOCK": 8, "SAMPLE": 1}.items():
        monkeypatch.setattr(shingle_dedup, name, value)
    plans, real = [], simhash.cut

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    for module in (shingle_dedup, simhash):
        monkeypatch.setattr(module, "cut", kept)
    pages = _pages(40, 2) | {i: " ".join(f"t{j}" for j in range(60)) + f" e{i % 7}" for i in range(100, 140)}
    found = shingle_dedup.similar_documents(spark.createDataFrame(list(pages.items()), "doc_id long, text string"))
    assert found.select("component").distinct().count() == 41
    assert max(p.count("Join ") for p in plans) <= 5
    slots = [line for p in plans for line in p.splitlines() if "Join " in line and "__word" in line]
    assert slots and all("LeftSemi" in line for line in slots)
