"""Panels of counts from typed facts, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(df: DataFrame, fact: str, *, kind: Column, status: Column) -> DataFrame:
    """(fact, kind, status) of the rows of df."""
    return df.select(F.lit(fact).alias("fact"), kind.cast("string").alias("kind"), status.cast("string").alias("status"))


def dashboards(facts: DataFrame, panels: dict[str, tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """(panel, label, status, n) of all panels: name -> (fact, level, statuses).

    level: status (a row for each status), kind (for each kind, over the statuses together) or both. Only the statuses named
    count; none named: all. The facts are grouped once, by grouping sets, however many panels there are. A label or status
    that the panel doesn't tell apart is null; so is one that is null in the facts.
    """
    wanted = F.lit(False)
    for fact, _, statuses in panels.values():
        wanted = wanted | ((F.col("fact") == fact) & (F.col("status").isin(*statuses) if statuses else F.lit(True)))
    # Each panel counts its own statuses, so a fact's row is marked with the panels that it is in.
    inside = F.array_compact(F.array(*[
        F.when((F.col("fact") == fact) & (F.col("status").isin(*statuses) if statuses else F.lit(True)), F.struct(F.lit(name).alias("panel"), F.lit(level).alias("level")))
        for name, (fact, level, statuses) in panels.items()]))
    marked = facts.where(wanted).select(F.explode(inside).alias("p"), "kind", "status").select("p.panel", "p.level", "kind", "status")
    sets = marked.groupingSets([["panel", "level", "status"], ["panel", "level", "kind"], ["panel", "level", "kind", "status"]], "panel", "level", "kind", "status").agg(
        F.count("*").alias("n"), F.grouping("kind").alias("no_kind"), F.grouping("status").alias("no_status"))
    at = F.when(F.col("no_kind") == 1, "status").when(F.col("no_status") == 1, "kind").otherwise("both")
    return sets.where(at == F.col("level")).select("panel", F.col("kind").alias("label"), "status", "n")
