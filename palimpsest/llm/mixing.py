"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the total size. A target stops at `MAX_TIMES`
its source's size; the excess goes to the others by weight until none is above.

Within a source every document expects target / size copies. Documents are put in order of size, expected copies are
summed along it, one random offset is added, and a document is emitted once for each integer boundary that its stretch
crosses. Because neighbours have like sizes, taken words come within about one largest document of the target.

The prefix sums are distributed: rows are range-partitioned by (source, size, id), counted by partition, and each
partition starts from the count before it; a hot source spans many partitions. Only one row for each source, or for each
source and partition, is ever brought together.

Size is the number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0. Cases: a source whose documents are all empty has
target 0 and takes none; repeated rows are documents of their own; ties are broken by id, then by the text's hash, and
rows alike in all of these are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import col, cut, partitions, without

WEIGHTS, MAX_TIMES, SEED = (5, 2, 1), 3, "mix"


def n_words(text: str) -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """(source, source_size) with weight and target; one row for each source.

    Sorted by cap over weight, the first k sources that the level of the rest would exceed are held at their caps; the
    level is what is left over the weights that are left. Everything is a whole number until the last division.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.lit(max_times) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(rest),
    }).withColumn("free", F.col("cap") * F.col("weights") >= F.col("weight") * F.col("left"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "weights"))).over(everything)
    levelled = level.withColumn("first", first)
    share = F.col("weight") * F.col("first.left") / F.col("first.weights")
    capped = F.col("first").isNull() | (F.col("cap") * F.col("first.weights") < F.col("weight") * F.col("first.left"))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(capped, F.col("cap").cast("double")).otherwise(share.cast("double"))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the seed and the source's name alone."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
    max_times: int = MAX_TIMES, seed: str = SEED,
) -> DataFrame:
    """(doc_id, __th, source, size, source_size, target, copies, taken) for each row of docs; __th tells texts of an id apart."""
    rows = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("__th"), col(source).cast("string").alias("source"), n_words(text).alias("size"))
    keys = (F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("__th"))
    # The first cut keeps the range sampler from counting all words once more; the second fixes which partition a row is
    # in: counts and ranks have to agree, also after a task is run again.
    dealt = cut(cut(rows).repartitionByRange(partitions(docs.sparkSession), *keys).withColumn("part", F.spark_partition_id()))
    counts = cut(dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    targets = source_targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_times=max_times)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("__s"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(targets.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy(*keys[1:]))
    ranked = dealt.withColumn("rank", rank).join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p")))
    at = F.col("start") + F.col("rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = (F.floor(rate * at + u) - F.floor(rate * (at - 1) + u)).cast("long")
    return ranked.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.lit(max_times))).select(
        "doc_id", "__th", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with a column `copy` from 1.

    Rows alike in id, text and source are emitted from one of them, as often as they are taken together.
    """
    taken = mix(docs, text=text, source=source, doc_id=doc_id, **options)
    one = taken.groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__t"), F.col("source").alias("__src")).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    same = col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(col(text)) == F.col("__t")) & col(source).cast("string").eqNullSafe(F.col("__src"))
    kept = [col(c) for c in without(docs, "copy")]
    joined = docs.join(one.where("__copies > 0"), same)
    single = joined.where("__rows = 1").select(*kept, "__copies")
    twins = joined.where("__rows > 1").groupBy("__id", "__t", "__src").agg(F.first(F.struct(*kept)).alias("__row"), F.first("__copies").alias("__copies"))
    both = single.unionByName(twins.select("__row.*", "__copies"))
    return both.select("*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy")).drop("__copies")
