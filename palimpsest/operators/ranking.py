"""Numbering all rows of a table, and short lists for each key, without bringing a table or a key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut

#: How long a list may get that a caller asks for.
MOST = 500


def capped_lists(df: DataFrame, by: Sequence[str], order: Sequence[Column], *, limit: int, most: int = MOST) -> DataFrame:
    """The first `limit` rows of each key in `order`, with `place` and `n_left_out`, the key's other rows. Null is a key.

    Spark cuts each key to `limit` rows before its shuffle, and sizes are pre-aggregated: a hot key sends a few rows from
    each partition. A limit below 1 or over `most` is a ValueError.
    """
    if not 1 <= limit <= most:
        raise ValueError(f"limit is {limit}: it has to be from 1 to {most}")
    first = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= limit)
    sizes = df.groupBy(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("__n"))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
    return first.join(sizes, same).withColumn("n_left_out", F.greatest(F.col("__n") - limit, F.lit(0))).select(*first.columns, "n_left_out")


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with 1, 2, ... in `order`, which has to be total.

    Rows are range-partitioned, counted by partition, and numbered within each from the count before it; only one row
    for each partition is ever together. The dealt rows are cut: counts and ranks have to see one dealing, also after a
    lost executor's tasks run again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__rank", rank).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__rank")).cast("bigint")).drop("__part", "__rank", "__start")
