"""op3's links refuse a distance at which they would lose some."""

import pytest

from palimpsest.llm import simhash


def test_more_than_two_bits_are_refused(spark):
    # Three differing bits in three quarters: no two quarters are equal.
    prints = spark.createDataFrame([(0,), (1 | 1 << 16 | 1 << 32,)], "fp long")
    with pytest.raises(ValueError, match="max_bits"):
        simhash.links(prints, max_bits=3)
