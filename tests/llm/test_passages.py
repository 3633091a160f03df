"""op1 on phrases whose codes are equal, and on copied short texts."""

import numpy as np
import pytest

from palimpsest.llm import substring_dedup


def _code(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return substring_dedup._letters(substring_dedup._words(data, np.array([0, len(data)])).hashes())


def _same_code():
    seen = {}
    for i in range(20_000):
        if (other := seen.setdefault(_code(f"v{i}"), f"v{i}")) != f"v{i}":
            return other, f"v{i}"


def _removed(spark, docs, n, k):
    shards = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = substring_dedup.remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string"), n=n, k=k).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shards)
    return {r.doc_id: r.n_removed for r in rows}


def test_phrases_of_one_code(spark):
    x, y = _same_code()
    docs = [(1, f"a b {x} d e f"), (2, f"a b {y} d e f"), (3, f"a b {x} d e f g"), (4, f"a b {y} d e f h")]
    assert _removed(spark, docs, 6, 6) == {1: 0, 2: 0, 3: 6, 4: 6}


@pytest.mark.parametrize("first", [0, 1, 2])
def test_copied_text_shorter_than_a_window(spark, first):
    passage = "a b c d e f".split()
    short = " ".join(passage[first : first + 4])
    filler = lambda x: " ".join(passage + [f"{x}{i}" for i in range(90_000)])
    assert _removed(spark, [(1, short), (2, short), (10, filler("x")), (11, filler("y"))], 6, 4) == {1: 0, 2: 0, 10: 0, 11: 6}
