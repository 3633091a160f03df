"""The ordered change feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ranking import global_row_number


def event_kind(states: DataFrame, keys: Sequence[str], order: Sequence[Column], state: str, kinds: dict[str, str], *, restored_from: str) -> DataFrame:
    """Rows of states whose state differs from the one before, with kind; the first rule that holds gives it.

    created (no row before), the kind that `kinds` gives the new state, restored (from `restored_from`), else updated.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = states.withColumns({"__prev": F.lag(state).over(w), "__n": F.row_number().over(w)})
    kind = F.when(F.col("__n") == 1, "created")
    for value, name in kinds.items():
        kind = kind.when(F.col(state) == value, name)
    kind = kind.when(F.col("__prev") == restored_from, "restored").otherwise("updated")
    return rows.where((F.col("__n") == 1) | ~F.col(state).eqNullSafe(F.col("__prev"))).withColumn("kind", kind).drop("__prev", "__n")


def lifecycle_kind(before: str, after: str) -> Column:
    """The full ladder on two states, each a struct of (redirect, active, version, is_split, change); null where nothing changed."""
    b, a = (lambda f, p=p: F.col(f"{p}.{f}") for p in (before, after))
    same = a("version").eqNullSafe(b("version")) & a("active").eqNullSafe(b("active")) & a("redirect").eqNullSafe(b("redirect"))
    none = a("version").isNull() & b("version").isNull()
    return (
        F.when(same | none, F.lit(None)).when(a("redirect").isNotNull() & b("redirect").isNull(), "merged")
        .when(~a("active") | a("version").isNull(), "unpublished").when(a("is_split"), "split")
        .when(~F.coalesce(b("active"), F.lit(True)) | b("redirect").isNotNull(), "restored").when(b("version").isNull(), "created")
        .when(a("change") == "extension", "extended").when(a("change") == "correction", "corrected").when(a("change") == "cancellation", "cancelled").otherwise("updated"))


def sequenced(events: DataFrame, order: Sequence[Column], *, after: int) -> DataFrame:
    """events with event_seq: after + 1, after + 2, ... in order. One writer calls it, with the last number given out."""
    return global_row_number(events, order, "event_seq").withColumn("event_seq", F.col("event_seq") + F.lit(after).cast("bigint"))
