"""Exact nearest neighbours for a stated set of queries, by pivots and the triangle inequality.

Vectors are scaled to length 1; the distance of two of them on the sphere's chord obeys the triangle inequality, and cosine
distance is half its square. A few vectors are pivots. Every vector belongs to the cell of its nearest pivot and to a ring
by its distance from it; rows are range-partitioned by cell, ring and key, so that a crowded cell spans many tasks, and
packed into blocks of one ring. A block tells the least and greatest distance of its vectors from each pivot; with a query's
own distances that bounds from below how near the block can be.

First each query meets the `FIRST` blocks that may be nearest. The `top`-th best distance found is its bar, and then it
meets the other blocks whose bound is below the bar, and no more. Queries meet blocks in a shuffle, in groups of bounded
size; none passes the driver. The pivots do: `PIVOTS` vectors, whatever the size of the table.

Vectors without length have no direction and are left out, as are null ones and ones with null or no finite components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut
from palimpsest.operators.packing import block_pairs, few_records, in_blocks, packed, rows_of

PIVOTS, RINGS, FIRST = 16, 8, 3
#: Queries that meet a block in one group.
CHUNK = 2048
#: Rounding of a distance to 6 digits, and of the arithmetic before it.
_SLACK = 6e-7


def first_of_each(values: np.ndarray, order: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `top` least values of each row, ties in `order` of columns; infinite values are never among them."""
    if values.shape[1] > 4 * top and len(values):
        # Only values up to a row's `top`-th are put in order, by value and then by place.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row, column = np.nonzero((values <= np.partition(values, top - 1, axis=1)[:, top - 1, None]) & np.isfinite(values))
        some = np.lexsort((place[column], values[row, column], row))
        row, column = row[some], column[some]
        first = np.r_[0, np.cumsum(np.bincount(row, minlength=len(values)))][:-1]
        kept = np.arange(len(row)) - first[row] < top
        return row[kept], column[kept]
    best = order[np.argsort(values[:, order], axis=1, kind="stable")[:, :top]]
    row = np.repeat(np.arange(len(values)), best.shape[1])
    fits = np.isfinite(values[row, best.ravel()])
    return row[fits], best.ravel()[fits]


def unit(vectors) -> np.ndarray:
    """One row for each vector, of length 1; all zero for a null vector or one of length 0."""
    size = max((len(v) for v in vectors if v is not None), default=0)
    x = np.array([v if v is not None else np.zeros(size) for v in vectors], float).reshape(len(vectors), size)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _placed(vectors: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(id, v, far, cell, ring): the unit vector, its distances from the pivots, its cell and ring."""
    fine = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(fine)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = unit(batch["v"].tolist())
                far = _chords(x, pivots)
                cell = far.argmin(axis=1)
                ring = np.minimum(far[np.arange(len(x)), cell] / 2 * RINGS, RINGS - 1).astype(int)
                yield pd.DataFrame({"id": batch["id"], "v": list(x), "far": list(far), "cell": cell, "ring": ring})

    return rows.mapInPandas(place, f"id {vectors.schema[key].dataType.simpleString()}, v array<double>, far array<double>, cell int, ring int")


def _blocks(placed: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(block, rows) and (block, low, high): packed rows, and their least and greatest distances from the pivots."""
    spark = placed.sparkSession
    dealt = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "ring", "id").sortWithinPartitions("cell", "ring", "id")
    blocks = cut(packed(dealt, "rows", block_bytes=block_bytes, within=("cell", "ring")).withColumn("block", F.monotonically_increasing_id()))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [_matrix(rows_of(batch, "rows", i).field("far")) for i in range(batch.num_rows)]
            ends = [pa.array([list(f(x, axis=0)) for x in far], pa.list_(pa.float64())) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("block")), *ends], names=["block", "low", "high"])

    with few_records(spark):
        return blocks, cut(blocks.mapInArrow(bounds, "block long, low array<double>, high array<double>"))


def _reach(asked: DataFrame, summaries: DataFrame, kind: str, first: int | None) -> DataFrame:
    """(id, block, least) of the blocks that a query may have to meet, by the bound `least` on cosine distance.

    With `first`, that many for each query, of least bound. Else those that reach the query's bar and weren't among them.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, b = rows_of(batch, "q", i), rows_of(batch, "b", i)
                far, low, high = _matrix(q.field("far")), _matrix(b.field("low")), _matrix(b.field("high"))
                least = np.zeros((len(far), len(low)))
                for p in range(far.shape[1]):
                    np.maximum(least, np.maximum(far[:, p, None] - high[:, p], low[:, p] - far[:, p, None]), out=least)
                least = least**2 / 2
                if first is not None:
                    row, column = first_of_each(least, np.argsort(b.field("block").to_numpy(), kind="stable"), first)
                else:
                    bar = q.field("bar").fill_null(np.inf).to_numpy(zero_copy_only=False)
                    row, column = np.nonzero(least - _SLACK <= bar[:, None])
                ids, blocks = (x.take(pa.array(at)) for x, at in ((q.field("id"), row), (b.field("block"), column)))
                yield pa.RecordBatch.from_arrays([ids, blocks, pa.array(least[row, column])], names=["id", "block", "least"])

    pairs = block_pairs(asked, packed(summaries, "b")).mapInArrow(met, f"id {kind}, block long, least double")
    if first is None:
        return pairs
    place = F.row_number().over(Window.partitionBy("id").orderBy("least", "block"))
    return pairs.withColumn("__place", place).where(F.col("__place") <= first).drop("__place")


def _meet(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, kind: str, top: int) -> DataFrame:
    """(q_id, id, distance) of the `top` rows that each query finds in each block it meets; pairs (id, block) are cut."""
    pairs = pairs.select(F.col("id").alias("q_id"), "block")
    sizes = pairs.groupBy("block").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.col("chunks").cast("long")))
    asked = dealt.join(queries.select(F.col("id").alias("q_id"), "v"), "q_id").select("block", "chunk", "q_id", "v")
    parts = blocks.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "rows")

    def best(queries: pa.Table, block: pa.Table) -> pa.Table:
        q, ids = _matrix(queries.column("v").combine_chunks()), queries.column("q_id").combine_chunks()
        out = []
        for i in range(block.num_rows if queries.num_rows else 0):
            rows = block.column("rows")[i].values
            keys, order = rows.field("id"), pa.compute.array_sort_indices(rows.field("id")).to_numpy()
            distance = np.round(1 - q @ _matrix(rows.field("v")).T, 6)
            distance[ids.to_numpy(zero_copy_only=False)[:, None] == keys.to_numpy(zero_copy_only=False)] = np.inf
            row, column = first_of_each(distance, order, top)
            out.append(pa.table([ids.take(pa.array(row)), keys.take(pa.array(column)), pa.array(distance[row, column])], names=["q_id", "id", "distance"]))
        nothing = pa.table([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=["q_id", "id", "distance"])
        return pa.concat_tables(out) if out else nothing

    return asked.groupBy("block", "chunk").cogroup(parts.groupBy("block", "chunk")).applyInArrow(best, f"q_id {kind}, id {kind}, distance double")


def nearest(queries: DataFrame, vectors: DataFrame, *, key: str, vector: str, top: int, block_bytes: int = 1 << 21, counts: bool = False):
    """(q_id, key, distance): for each query the `top` others by cosine distance, rounded to 6 digits, ties by key.

    queries: rows of the same columns as vectors; vectors have one length. With counts, also a frame of one row (pairs, met):
    how many pairs of query and row there are, and of how many the distance was computed.
    """
    kind = vectors.schema[key].dataType.simpleString()
    fine = vectors.where(F.exists(F.col(vector), lambda x: x != 0)).where(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x)))
    pivots = unit([r[0] for r in fine.orderBy(F.xxhash64(key), key).select(F.col(vector).cast("array<double>")).limit(PIVOTS).collect()])
    blocks, summaries = _blocks(_placed(vectors, key, vector, pivots), block_bytes)
    asked = cut(_placed(queries, key, vector, pivots).select("id", "v", "far"))
    spark = vectors.sparkSession
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))
    ranked = lambda found: cut(found.withColumn("place", place).where(F.col("place") <= top))
    with few_records(spark):
        first = cut(_reach(in_blocks(asked.select("id", "far"), "q", "id", row_bytes=8 * PIVOTS), summaries, kind, FIRST))
    best = ranked(_meet(first, asked, blocks, kind, top))
    bars = asked.join(best.where(F.col("place") == top).select(F.col("q_id").alias("id"), F.col("distance").alias("bar")), "id", "left")
    with few_records(spark):
        left = _reach(in_blocks(bars.select("id", "far", "bar"), "q", "id", row_bytes=8 * PIVOTS), summaries, kind, None)
        left = cut(left.join(first.select("id", "block"), ["id", "block"], "left_anti"))
    best = best.drop("place").unionByName(_meet(left, asked, blocks, kind, top)).withColumn("place", place).where(F.col("place") <= top)
    found = best.select("q_id", F.col("id").alias(key), "distance")
    if not counts:
        return found
    sizes = blocks.select("block", F.size("rows").alias("n"))
    met = first.select("block").union(left.select("block")).join(sizes, "block").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))
    return found, asked.agg(F.count("*").alias("q")).crossJoin(sizes.agg(F.sum("n").alias("n"))).crossJoin(met).select((F.col("q") * F.col("n")).alias("pairs"), "met")
