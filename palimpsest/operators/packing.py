"""Rows packed into blocks, so that a join of two tables forms pairs of blocks and the work on them is numpy's."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Bytes of a block.
BLOCK_BYTES = 1 << 20


def packed(df: DataFrame, name: str, *, block_bytes: int = BLOCK_BYTES, within: Sequence[str] = ()) -> DataFrame:
    """One column `name`, an array of the rows of df: about block_bytes each, one row at least.

    Nothing moves: a task packs what it reads, in its order. within: columns that are equal for the rows of a block.
    """
    schema = StructType([StructField(name, ArrayType(df.schema, False), False)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            rows = pa.StructArray.from_arrays(whole.columns, names=whole.schema.names)
            step = max(1, block_bytes * whole.num_rows // max(whole.nbytes, 1))
            ends = [whole.num_rows]
            if within:
                keys = list(zip(*[whole.column(whole.schema.get_field_index(c)).to_pylist() for c in within]))
                ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + ends
            start = 0
            for end in ends:
                for a in range(start, end, step):
                    some = rows.slice(a, min(step, end - a))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], names=[name])
                start = end

    return df.mapInArrow(pack, schema)


def in_blocks(df: DataFrame, name: str, key: str, *, row_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df packed into as few blocks as its number of rows asks for, dealt by a hash of `key`."""
    n = max(1, -(-df.count() * row_bytes // block_bytes))
    return packed(df.repartition(n, key), name, block_bytes=2 * block_bytes)


#: Whole texts or pages that go to a Python worker at once.
TEXT_ROWS = 256


def small_text_batches(spark: SparkSession, n: int = TEXT_ROWS) -> None:
    """At most n records go to Python at once: a batch is held whole there, several times over while it is parsed.

    A setting of the session, because a query is run after its function has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= n:
        spark.conf.set(name, n)


@contextmanager
def few_records(spark: SparkSession, n: int = 8) -> Iterator[None]:
    """While it holds, at most n records go to Python at once: a pair of blocks is a large record."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rows_of(batch: pa.RecordBatch, name: str, i: int) -> pa.StructArray:
    """The rows of the block in record i."""
    return batch.column(batch.schema.get_field_index(name))[i].values


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each block of left with each of right; Spark broadcasts a side only if it is small."""
    return left.crossJoin(right)


def numbered_blocks(blocks: DataFrame, name: str = "block") -> DataFrame:
    """blocks, which have to be cut, with a number for each."""
    return blocks.withColumn(name, F.monotonically_increasing_id())
