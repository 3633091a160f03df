"""A deterministic stand-in for an embedding model: signed feature hashing of tokens, scaled to length 1.

It needs no model file and stays in the JVM. A real provider plugs in as an Arrow UDF from texts to arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 64


def hashed(token: Column) -> Column:
    """The first 32 bits of the token's MD5, as a whole number."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def embed_texts(docs: DataFrame, *, key: str, tokens: Column, size: int = SIZE) -> DataFrame:
    """(key, vector) of the documents by their tokens, an array; keys are unique. Without tokens all numbers are 0.

    A token counts 1 or -1, by the lowest bit of its hash, at the place that the other bits give. Tokens are summed where
    they are read, so that a document sends `size` numbers at most.
    """
    h = hashed(F.col("token"))
    signed = docs.select(key, F.explode(tokens).alias("token")).select(
        key, F.pmod(F.shiftright(h, 1), F.lit(size)).cast("int").alias("at"), F.when(h.bitwiseAND(1) == 1, 1).otherwise(-1).alias("sign"))
    sums = signed.groupBy(key, "at").agg(F.sum("sign").cast("double").alias("x"))
    found = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    number = lambda i: F.when(F.col("length") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("length")).otherwise(F.lit(0.0))
    return docs.select(key).join(found, key, "left").select(key, F.transform(places, number).alias("vector"))
