"""Line differences."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unified(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of two texts' lines without file names; empty for equal ones."""
    def one(a, b):
        return "\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm=""))

    return pd.Series([one(a, b) for a, b in zip(before, after)])
