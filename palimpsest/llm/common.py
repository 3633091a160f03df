"""What the operators share: columns, identity of a document, cutting of lineage.

Identity. An operator that has to bring results back to its rows joins on (doc_id, xxhash64 of the text), null-safe:
repeated rows are one document to the statistics, and each of them gets that document's result.
Clashes. A result column replaces an input column of the same name, whatever its case.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The six ASCII white-space bytes that part words: space and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of df that no name equals, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where none is set, one of our own is used on a local master, as in tests; a cluster has to name one. The folder's
    owner clears it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and all executors can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: str) -> Column:
    """Tells apart the texts of rows with one doc_id; a null text is a value of its own."""
    return F.when(col(text).isNull(), F.lit(None)).otherwise(F.xxhash64(col(text)))


def held_out(doc_id: str, folds: int = 5) -> Column:
    """True for the fold that training never sees: crc32 of the id's decimal text, modulo folds, is 0."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def add_columns(
    df: DataFrame, text: str, fields: list[StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """df with columns that `make()`'s function computes from an Arrow array of texts, batch by batch.

    `make` runs once in each task, so that models and tables are unpacked once.
    """
    names = [f.name for f in fields]
    kept = without(df, *names)
    # By number, so that no name of a column can clash or be taken for a path.
    source = df.select(*[col(c).alias(f"_{i}") for i, c in enumerate(kept)], col(text).alias("_text"))
    schema = StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for batch in small_batches(whole, "_text"):
                columns = [batch.column(i) for i in range(batch.num_columns - 1)] + compute(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    return source.mapInArrow(run, schema)


def small_batches(batch: pa.RecordBatch, text: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - 1) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def one_of_each(docs: DataFrame, chosen: DataFrame, *, text: str, doc_id: str) -> DataFrame:
    """The rows of docs that `chosen` (__id, __th, __rows) names by id and text_hash: one row for each.

    __rows says how many rows there are; where it is over 1, rows alike in id and text give one of them.
    """
    kept = [col(c) for c in docs.columns]
    joined = docs.join(chosen, col(doc_id).eqNullSafe(F.col("__id")) & text_hash(text).eqNullSafe(F.col("__th")))
    twins = joined.where("__rows > 1").groupBy("__id", "__th").agg(F.first(F.struct(*kept)).alias("__row"))
    return joined.where("__rows = 1").select(*kept).unionByName(twins.select("__row.*"))
