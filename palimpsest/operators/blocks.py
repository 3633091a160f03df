"""Typed text blocks: boilerplate, extraction input, keys and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_key(prefix: Column | str, number: Column) -> Column:
    """prefix:000000"""
    return F.format_string("%s:%06d", F.lit(prefix) if isinstance(prefix, str) else prefix, number)


def lines(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, pos, line) of each text's lines."""
    return docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def boilerplate_lines(docs: DataFrame, *, key: str, text: str, at_least: int) -> DataFrame:
    """(line, n): non-blank lines of `at_least` different documents."""
    return lines(docs, key=key, text=text).where(F.trim("line") != "").groupBy("line").agg(F.countDistinct(key).alias("n")).where(F.col("n") >= at_least)


def extraction_input(docs: DataFrame, *, key: str, text: str, boilerplate_from: int = 5) -> DataFrame:
    """(key, n_blocks, input_sha256): non-blank lines that aren't boilerplate, in order, and the hash of their hashes."""
    common = boilerplate_lines(docs, key=key, text=text, at_least=boilerplate_from).select("line")
    kept = lines(docs, key=key, text=text).where(F.trim("line") != "").join(common, "line", "left_anti")
    each = kept.select(key, F.struct("pos", F.sha2("line", 256).alias("sha")).alias("x"))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(key, F.size("x").cast("bigint").alias("n_blocks"), F.sha2(F.array_join("x.sha", "\n"), 256).alias("input_sha256"))
