"""Queue and polling semantics as batch queries over append-only rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wordings of errors that pass by themselves.
TRANSIENT_WORDS = "timed? ?out|connection|rate limit|overloaded"


def claim(jobs: DataFrame, *, now: Column, available: str, first: Column, key: str, batch: int) -> DataFrame:
    """The next jobs that may run: those in `first` before others, then the oldest, with status running and attempt + 1."""
    due = jobs.where(F.col(available) <= now).orderBy(~first, available, key).limit(batch)
    return due.withColumns({"status": F.lit("running"), "attempt": F.col("attempt") + 1})


def stale_to_retry(jobs: DataFrame, *, status: str, running: str, heartbeat: str, now: Column, minutes: int) -> DataFrame:
    stale = (F.col(status) == running) & (F.col(heartbeat) < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn(status, F.when(stale, "retry").otherwise(F.col(status)))


def is_transient(code: Column, kind: Column, message: Column, *, codes: Sequence[int], kinds: Sequence[str]) -> Column:
    """By status code, class name or wording; an unknown code counts as none."""
    return F.coalesce(code.isin(*codes), F.lit(False)) | kind.isin(*kinds) | F.lower(message).rlike(TRANSIENT_WORDS)


def barrier_open(jobs: DataFrame, keys: Sequence[str], pending: Column) -> DataFrame:
    """Keys of which no job is pending."""
    return jobs.groupBy(*keys).agg(F.count_if(pending).alias("__pending")).where("__pending = 0").select(*keys)


def inherit_missing(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df with `name`: the value, or where it is null the last one before that isn't."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.col(value), F.last(value, ignorenulls=True).over(before)))


def trailing_count(df: DataFrame, keys: Sequence[str], at: str, *, seconds: int, name: str) -> DataFrame:
    """df with `name`: rows of the key in the `seconds` up to this row's time, all of that time included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(name, F.count("*").over(w))


def cross_check_reason(size: Column, failed: Column, items: Column, *, many: int = 2, long: int = 20_000) -> Column:
    """Why an extraction is checked again; null: it isn't."""
    return F.when(size == 0, "empty").when(failed, "coverage").when(items >= many, "many").when(size >= long, "long")
