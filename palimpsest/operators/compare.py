"""Comparing two states of the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def full_diff(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, before, after, change): added, removed, changed or unchanged by null-safe equality of `value`."""
    left = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("__l"))
    right = after.select(*key, F.col(value).alias("after"), F.lit(True).alias("__r"))
    change = (
        F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed"))
    return left.join(right, list(key), "full").select(*key, "before", "after", change.alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str], rules: dict[str, object]) -> DataFrame:
    """One row per key of either side; `rules` gives each column from the pair, as a function of (old, new) columns."""
    old = current.select(*key, *[F.col(c).alias(f"__o_{c}") for c in current.columns if c not in key], F.lit(True).alias("__old"))
    new = incoming.select(*key, *[F.col(c).alias(f"__n_{c}") for c in incoming.columns if c not in key], F.lit(True).alias("__new"))
    both = old.join(new, list(key), "full")
    cells = [rule(F.col(f"__o_{c}"), F.col(f"__n_{c}")).alias(c) for c, rule in rules.items()]
    return both.select(*key, *cells, F.coalesce("__old", F.lit(False)).alias("existed"))


def insert_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of incoming whose key isn't there yet, one for each key."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def predecessor(df: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str]) -> DataFrame:
    """df with prev_<column>: the values of the row before in the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
