"""A persisted inverted index, and BM25 from its postings alone.

Documents are dealt to shards of about `per_shard`, within classes of like length, by a hash of their key: a pure function of
the row, so that no text moves for it. A row of the index holds the postings of one term in one shard, with their number and
the greatest weight among them; a weight is the part of BM25 that doesn't depend on the query. Of the bounds of a query's
terms in a shard follows what a document of that shard can score at most.

A search sums those bounds for each query and shard, scores the shards that promise most, and keeps the `top`-th best score
as the bar. Shards that can't reach the bar are never read. In the others a query's terms are put in order of their bounds:
the first ones, as long as they can't reach the bar together, can't lift a document that has no other term over it. So only
the other terms' postings are read at first, and the frequent terms' where a document is found that may still reach it.
Each round takes `GROWTH` times as many shards as all before, so that the bar rises while few postings are read and the
rounds stay few. The result is that of a full scan, ties included.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut, shared_folder
from palimpsest.operators.packing import small_text_batches
from palimpsest.operators.retrieval import tokens

PER_SHARD, FIRST, GROWTH, DIGITS = 128, 4, 4, 6


@dataclass(frozen=True)
class PostingsIndex:
    """postings (term, shard, n, most, found: array of (key, weight)), terms (term, docs), and how many documents there are."""

    path: str
    postings: DataFrame
    terms: DataFrame
    documents: int


def _length_class(size: Column) -> Column:
    """Classes whose lengths are within a factor of about 1.4."""
    return F.floor(F.log2(size + 1) * 2).cast("int")


def _counted(rows: DataFrame) -> DataFrame:
    """(key, size, term, f) of (key, t): a document's distinct tokens and how often it has each, counted where it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, sizes = batch.column(1), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            known = t.flatten().dictionary_encode()
            n = max(len(known.dictionary), 1)
            pairs, times = np.unique(np.repeat(np.arange(len(t)), sizes) * n + known.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(t) + 1) * n).astype(np.int32))
            terms = known.dictionary.take(pa.array(pairs % n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))],
                names=["key", "size", "term", "f"])

    small_text_batches(rows.sparkSession)
    return rows.mapInArrow(count, f"key {rows.schema['key'].dataType.simpleString()}, size int, term array<string>, f array<long>")


def build_postings(
    docs: DataFrame, *, key: str, text: str, path: str | None = None, per_shard: int = PER_SHARD, k1: float = 1.2, b: float = 0.75
) -> PostingsIndex:
    """The index of docs, whose keys have to be unique, written to `path` (of the shared folder if None).

    A document without tokens counts for the mean length and is in no posting. Two numbers and a row for each class of
    lengths, of which there are some 60, come to the driver.
    """
    rows = cut(_counted(docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))))
    classes = rows.groupBy(_length_class(F.col("size")).alias("c")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    documents, words = sum(r["n"] for r in classes), sum(r["size"] for r in classes)
    mean = words / documents if words else 1.0
    shards = F.create_map(*[F.lit(x) for r in classes for x in (r["c"], -(-r["n"] // per_shard))]) if classes else F.create_map(F.lit(0), F.lit(1))
    shard = F.shiftleft(_length_class(F.col("size")).cast("long"), 40) + F.pmod(F.xxhash64("key"), F.try_element_at(shards, _length_class(F.col("size"))))
    counted = rows.select("key", "size", shard.alias("shard"), F.explode(F.arrays_zip("term", "f")).alias("x")).select("key", "size", "shard", "x.term", "x.f")
    weight = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("size") / F.lit(mean)))
    # The one time that postings move: they are grouped, sorted and written where they come to.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.select("term", "shard", "key", weight.alias("weight")).repartition(parts, "term", "shard")
    postings = dealt.groupBy("term", "shard").agg(F.count("*").cast("int").alias("n"), F.max("weight").alias("most"), F.collect_list(F.struct("key", "weight")).alias("found"))
    path = path or f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    postings.sortWithinPartitions("term", "shard").write.parquet(f"{path}/postings")
    known = docs.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
    known.groupBy("term").agg(F.sum("n").alias("docs")).withColumn("documents", F.lit(documents)).write.parquet(f"{path}/terms")
    return open_postings(docs.sparkSession, path)


def open_postings(spark: SparkSession, path: str) -> PostingsIndex:
    """An index that was written before."""
    terms = spark.read.parquet(f"{path}/terms")
    first = terms.select("documents").first()
    return PostingsIndex(path, spark.read.parquet(f"{path}/postings"), terms, first[0] if first else 0)


def _bar(best: DataFrame, top: int) -> DataFrame:
    return best.where(F.col("place") == top).select("q_id", F.col("score").alias("bar"))


def _reaches(most: Column) -> Column:
    """Whether `most` may reach the column `bar`: rounding may lift a score by half a digit."""
    return F.col("bar").isNull() | (most * (1 + 1e-12) + 10.0**-DIGITS >= F.col("bar"))


def _scored(cells: DataFrame, turn: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q_id, key, score) of the documents of turn (q_id, shard, bar) that may reach the bar, and (q_id, read)."""
    running = F.sum("bound").over(Window.partitionBy("q_id", "shard").orderBy("bound", "term"))
    known = cells.join(turn, ["q_id", "shard"]).withColumn("first", _reaches(running))
    rest = F.sum(F.when(~F.col("first"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy("q_id", "shard"))
    known = cut(known.withColumn("rest", rest))

    def exploded(some: DataFrame, *columns: str) -> DataFrame:
        met = some.join(postings.select("term", "shard", "found"), ["term", "shard"]).select("q_id", "idf", *columns, F.explode("found").alias("x"))
        return met.select("q_id", *columns, F.col("x.key").alias("key"), (F.col("idf") * F.col("x.weight")).alias("s"))

    partial = exploded(known.where("first"), "shard", "bar", "rest").groupBy("q_id", "shard", "key").agg(F.sum("s").alias("s"), F.first("rest").alias("rest"), F.first("bar").alias("bar"))
    kept = cut(partial.where(_reaches(F.col("s") + F.col("rest"))).select("q_id", "shard", "key", "s"))
    later = known.where("NOT first").join(kept.select("q_id", "shard"), ["q_id", "shard"], "left_semi")
    more = exploded(later).join(kept.select("q_id", "key"), ["q_id", "key"], "left_semi")
    scored = kept.select("q_id", "key", "s").unionByName(more.select("q_id", "key", "s")).groupBy("q_id", "key").agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return scored, known.where("first").select("q_id", "n").unionByName(later.select("q_id", "n")).groupBy("q_id").agg(F.sum("n").alias("read"))


def _best(scored: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def search_postings(index: PostingsIndex, queries: DataFrame, *, top: int, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(q_id, key, score, place) and (q_id, postings, read): the `top` documents of each query (q_id, query) by BM25.

    idf is ln(1 + (N - n + 0.5) / (n + 0.5)); a query counts each distinct token once; only documents with a token of the
    query are found. Scores are rounded to 6 digits, ties go by key. The second frame says how many postings the query's
    terms have and how many of them were read. A query without a known token has no rows in either.
    """
    n = F.col("docs")
    idf = F.log(1 + (F.lit(index.documents) - n + 0.5) / (n + 0.5))
    asked = queries.select("q_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    asked = cut(asked.join(index.terms, "term").select("q_id", "term", idf.alias("idf")))
    # The bounds are columns of their own: the postings themselves aren't read here.
    bound = (F.col("idf") * F.col("most")).alias("bound")
    cells = cut(asked.join(index.postings.select("term", "shard", "n", "most"), "term").select("q_id", "shard", "term", "idf", "n", bound))
    order = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("most").desc(), "shard"))
    left = cut(cells.groupBy("q_id", "shard").agg(F.sum("bound").alias("most")).withColumn("order", order))
    total = cells.groupBy("q_id").agg(F.sum("n").alias("postings"))
    best, read, upto, before = None, [], FIRST, 0
    while True:
        bars = left.select("q_id").distinct().withColumn("bar", F.lit(None).cast("double")) if best is None else _bar(best, top)
        left = cut(left.where(F.col("order") > before).join(bars, "q_id", "left").where(_reaches(F.col("most"))).select(*left.columns))
        turn = left.where(F.col("order") <= upto).select("q_id", "shard").join(bars, "q_id", "left")
        if left.isEmpty():
            break
        part, n_read = _scored(cells, turn, index.postings)
        read.append(n_read)
        best = cut(_best(part if best is None else best.drop("place").unionByName(part), top))
        before, upto = upto, upto * (1 + GROWTH)
    if best is None:
        kind = index.postings.schema["found"].dataType.elementType["key"].dataType
        nothing = left.select("q_id", F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("place")).where("false")
        return nothing, total.withColumn("read", F.lit(0).cast("long")).where("false")
    reads = reduce(DataFrame.unionByName, read).groupBy("q_id").agg(F.sum("read").alias("read"))
    return best.withColumnRenamed("key", key), total.join(reads, "q_id")
