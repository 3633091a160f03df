"""Scores against products, and mined negatives against brute force, for any sizes of blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score string, V int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 27), st.integers(0, 2**32), st.sampled_from([1, 7, 300, 40_000, 1 << 22]))
def test_scores_are_products(rows, anchors, dims, seed, size):
    r = np.random.default_rng(seed)
    x, a = (r.integers(-size, size + 1, (n, dims)) for n in (rows, anchors))
    pad = lambda v: np.pad(v, ((0, 0), (0, -dims % 8)))
    assert (hn.scores(hn.subset_sums(pad(a)), hn.bit_planes(pad(x))) == x @ a.T).all()


def test_unequal_dimensions_and_large_numbers():
    x, a = np.ones((3, 16), np.int64), np.full((2, 8), 5)
    assert (hn.scores(hn.subset_sums(a), hn.bit_planes(x)) == 40).all()
    with pytest.raises(ValueError):
        hn.scores(hn.subset_sums(np.full((1, 8), 1 << 40)), hn.bit_planes(np.full((1, 8), 1 << 20)))
    with pytest.raises(ValueError):
        hn.whole_numbers(pa.array([[1e300]]), 256)
    assert hn.whole_numbers(pa.array([[0.5, -0.001], [], [1.0]]), 256).tolist() == [[128, -1, 0, 0, 0, 0, 0, 0], [0] * 8, [256, 0, 0, 0, 0, 0, 0, 0]]


def _brute(rows, positives=5, negatives=3):
    fine = [(k, q, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for k, q, v in rows
            if None not in (k, q, v) and all(x is not None and math.isfinite(x) for x in v)]
    out, anchors = [], {}
    for k, q, v in sorted(fine, key=lambda r: (r[0], r[1], r[2])):
        if k % 50 == 0:
            anchors.setdefault(k, (q, v))
    for k, (q, v) in anchors.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i, p) for i, p, w in fine if i != k), key=lambda x: x[:2])
        for s, i, _ in [x for x in scored if x[2] == q][:positives]:
            fits = [x for x in scored if x[2] != q and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(k, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def _mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect())


def _rows(n, seed, hot):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        label = 1 if r.random() < hot else r.randrange(4)
        v = [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(9)] if r.random() < 0.5 else [r.gauss(label / 2, 0.4) for _ in range(9)]
        rows.append((k, label, v))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"rows_per_block": 7, "anchors_per_block": 2}])
def test_mined_rows_are_those_of_brute_force(spark, sizes):
    rows = _rows(310, 5, 0.4)
    # A third are copies of one vector; others have nulls, no numbers, other lengths, an id again.
    rows += [(1000 + i, i % 3, [0.5] * 9) for i in range(150)]
    rows += [(None, 1, [1.0]), (3001, None, [1.0]), (3002, 1, None), (3003, 1, [None, 1.0]), (3004, 1, [float("nan")]), (3050, 1, [float("inf")]), (3006, 0, []), (3007, 2, [2.0, 2.0])]
    rows += [(3100, 0, [1.0] * 9), (3100, 2, [1.0] * 9), (17, 1, [0.5] * 9), (17, 1, [0.5] * 9)]
    found = _mined(spark, rows, **sizes)
    assert found == _brute(rows) and len(found) > 50


def test_no_rows_and_a_lone_anchor(spark):
    assert _mined(spark, []) == [] and _mined(spark, [(50, 1, [1.0])]) == [] and _mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert _mined(spark, [(50, 1, [1.0]), (2, 1, [1.0]), (3, 2, [0.75])]) == [(50, 2, 1, 3, 65536, 49152)]
