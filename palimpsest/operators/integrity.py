"""Integrity: each rule is a query of its violations; good data gives none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Links that are joined and counted by one task.
PART_ROWS = 1 << 18


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows; a null is equal to a null."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def broken(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false; an unknown one passes, as a check constraint does."""
    return df.where(~F.coalesce(rule, F.lit(True)))


def report(rules: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(rule, subject) of all violations; each rule with the column that names its subject."""
    parts = [df.select(F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject")) for name, (df, subject) in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def rewritten(before: DataFrame, after: DataFrame, key: str, frozen: Sequence[str]) -> DataFrame:
    """(key, how): rows of an append-only table that were deleted, or whose frozen columns changed."""
    mark = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*frozen), {"ignoreNullFields": "false"}), 256).alias("h"))
    both = mark(before).withColumnRenamed("h", "__b").join(mark(after).withColumnRenamed("h", "__a"), key, "left")
    how = F.when(F.col("__a").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(key, how.alias("how")).where("how IS NOT NULL")


def unfounded_revalidations(fetches: DataFrame, *, key: str, reuses: str, same: Sequence[str], outcome: str, started: str, finished: str) -> DataFrame:
    """Fetches that say `not_modified` without a successful one of the same resource before them.

    The fetch that they name has to agree in the columns `same`, to be received or itself confirmed, and to have finished when
    they started. An unknown value agrees with none.
    """
    earlier = fetches.where(F.col(outcome).isin("received", "not_modified"))
    earlier = earlier.select(F.col(key).alias("__key"), F.col(finished).alias("__at"), *[F.col(c).alias(f"__{c}") for c in same])
    fits = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in same], (F.col(reuses) == F.col("__key")) & (F.col("__at") <= F.col(started)))
    return fetches.where(F.col(outcome) == "not_modified").join(earlier, fits, "left_anti")


def foreign_blocks(links: DataFrame, chunks: DataFrame, blocks: DataFrame, *, chunk: str, block: str, document: str) -> DataFrame:
    """(chunk, foreign_blocks): chunks with blocks of another document than their own, and how many; links (chunk, block).

    Links are dealt into parts of about `PART_ROWS`, since a part is sorted and held in several aggregations at once; Spark
    would join parts up to a size on disk, and keys that pack well take many times that in memory.
    """
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // PART_ROWS))
    owned = links.repartition(parts, chunk).join(chunks.select(chunk, F.col(document).alias("__own")), chunk).join(blocks.select(block, F.col(document).alias("__of")), block)
    return owned.where(F.col("__own") != F.col("__of")).groupBy(chunk).agg(F.countDistinct(block).alias("foreign_blocks"))
