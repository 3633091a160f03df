"""What operators share that look for few rows among many: a slot table, and the passage operators' shards.

Documents that cannot hold a repeat never leave their scan. The others are sent, once, to the shard that a hash of their
id names. Which they are is told by a table of at most `SLOTS` hash slots, so that its broadcast has a fixed bound: with
very many documents most slots are taken and the filter passes more, but nothing that it should keep is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from palimpsest.llm.common import col, cut, partitions, text_hash

SLOTS, SHARD_BYTES = 1 << 23, 32 << 20
NO_ID = (1 << 63) - 1


def slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*(keys or ("id", "th"))), F.lit(SLOTS)).cast("int")


def numbered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, th, text): a null id becomes the largest long, so that it is smaller than none; a null text becomes empty.

    Ids have to be whole numbers under 2 ** 63 - 1, by which texts are ordered and named; others are a ValueError.
    """
    kind = docs.select(col(doc_id)).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{doc_id} has to be a whole number, not {kind.simpleString()}")
    return docs.select(
        F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(text_hash(text), F.lit(0)).alias("th"),
        F.coalesce(col(text), F.lit("")).alias("text"))


def copies(rows: DataFrame) -> tuple[DataFrame, int]:
    """(id, th, least): of texts that several ids or rows have, each id, and the least id with that text; and all bytes."""
    light = cut(rows.select("id", "th", F.xxhash64(F.lit(1), "text").alias("other"), F.octet_length("text").cast("long").alias("size")))
    # The groups are cut, so that the join is one of two exchanges of its own, in which a group of many copies is split.
    groups = cut(light.groupBy("th", "other").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    same = cut(light.join(groups, ["th", "other"]).select("id", "th", "least").distinct())
    return same, light.agg(F.sum("size")).first()[0] or 0


def shard_count(spark: SparkSession, size: int) -> int:
    """Shards for texts of `size` bytes: of `SHARD_BYTES` at most, and one for each partition of a shuffle at least.

    A task works on its shards one after another, so its memory follows a shard, not the number of partitions.
    """
    return max(partitions(spark), -(-size // SHARD_BYTES))


def _bit() -> Column:
    return F.expr("shiftleft(1L, CAST(__slot % 64 AS INT))")


def _word() -> Column:
    return F.floor(F.col("__slot") / 64).cast("int")


def _taken(wanted: DataFrame, at: Column) -> DataFrame:
    """(__word, __bits): 64 slots each, with a bit for every slot that a row of `wanted` is in."""
    return cut(wanted.select(at.alias("__slot")).groupBy(_word().alias("__word")).agg(F.bit_or(_bit()).alias("__bits")))


def marked(rows: DataFrame, wanted: DataFrame, at: Column) -> tuple[DataFrame, Column]:
    """rows with the bits of their slot's word, and whether a row of `wanted` is in the same slot."""
    found = rows.withColumn("__slot", at).withColumn("__word", _word()).join(F.broadcast(_taken(wanted, at)), "__word", "left")
    return found, F.coalesce(F.col("__bits").bitwiseAND(_bit()) != 0, F.lit(False))


def in_slots(rows: DataFrame, wanted: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows in a slot of `wanted`, with their shard; the other rows)."""
    found, hit = marked(rows, wanted, slot())
    return found.where(hit).select(*rows.columns, shard(shards).alias("shard")), found.where(~hit).select(*rows.columns)


def maybe_in(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows with keys that `wanted` has, and a few others: those in one slot with such a key. Nothing is shuffled."""
    found, hit = marked(rows, wanted, slot(*keys))
    return found.where(hit).select(*rows.columns)


def only_in(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of `maybe_in`, told apart within the join, so that it makes no row that isn't kept."""
    at = slot(*keys)
    taken = F.broadcast(_taken(wanted, at).withColumnRenamed("__word", "__at"))
    same = (F.col("__word") == F.col("__at")) & (F.col("__bits").bitwiseAND(_bit()) != 0)
    return rows.withColumn("__slot", at).withColumn("__word", _word()).join(taken, same, "left_semi").select(*rows.columns)


def shard(shards: int) -> Column:
    return F.pmod(F.hash("id"), F.lit(shards))
