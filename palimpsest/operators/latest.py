"""Current state from append-only rows: latest row per key, overrides, islands of change, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in `order`, which has to be total; a null key is a key of its own."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__rank")


def fold_latest(df: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """Like latest_by for one row, by aggregation: combines before the shuffle, so a hot key costs one row a task."""
    packed = F.max_by(F.struct(*values), order)
    return df.groupBy(*keys).agg(packed.alias("__row")).select(*keys, "__row.*")


def effective_overrides(commands: DataFrame, keys: Sequence[str], order: Sequence[Column], action: str = "action") -> DataFrame:
    """The latest command of each key where it is a 'set'. A later 'remove' hides the key: no earlier 'set' comes back."""
    return latest_by(commands, keys, order).where(F.col(action) == "set")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """df with changed (value differs from the row before, null-safe; true for the first) and revision (1, 2, ...)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = first | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("changed", changed).withColumn("revision", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def missing_counter(df: DataFrame, keys: Sequence[str], order: Sequence[Column], seen: str, threshold: int = 3) -> DataFrame:
    """df with missing (rows in a row that weren't seen, up to this one) and availability by it.

    A seen row resets the count. `uncertain` from 1, `unavailable` from threshold.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    streak = F.sum(F.col(seen).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inner = Window.partitionBy(*keys, "__streak").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__streak", streak).withColumn("missing", F.sum(F.when(F.col(seen), 0).otherwise(1).cast("long")).over(inner)).drop("__streak")
    state = F.when(F.col("missing") == 0, "available").when(F.col("missing") >= threshold, "unavailable").otherwise("uncertain")
    return out.withColumn("availability", state)


def next_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], base: DataFrame, last: str) -> DataFrame:
    """df with number: goes on after base's `last` of the key, from 1 without one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = df.withColumn("__n", rank).join(base.select(*keys, F.col(last).alias("__last")), list(keys), "left")
    return joined.withColumn("number", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")
