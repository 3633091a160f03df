"""The incremental operators as Structured Streaming queries.

Each takes a stream of rows and returns a stream; `settle` runs one over all that is there and gives the final rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.operators.lineage import shared_folder


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files; time stamps without zone become ones with the session's."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def tumbling_counts(rows: DataFrame, *, keys: Sequence[str], at: str, width: str, late: str) -> DataFrame:
    """(keys, start, n) of each window; rows later than `late` behind the newest are dropped."""
    counted = rows.withWatermark(at, late).groupBy(*keys, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), "n")


def first_requests(rows: DataFrame, *, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """The first row of each key; a repeat within `late` is the same request."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def missing_streaks(rows: DataFrame, *, key: str, at: str, tie: str, seen: str) -> DataFrame:
    """(key, missing): after each batch, how many rows in a row weren't seen. State holds one number for each key.

    Rows are put in order within a batch; batches have to come in order of time, as files of a feed do. A row that comes
    in a later batch than a younger one counts where it comes, so its streak can be wrong; the batch operator has none of that.
    """

    def count(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missing = state.get[0] if state.exists else 0
        new = pd.concat(batches).sort_values([at, tie])
        for ok in new[seen]:
            missing = 0 if ok else missing + 1
        state.update((missing,))
        yield pd.DataFrame({key: [k[0]], "missing": [missing]})

    return rows.select(key, at, tie, seen).groupBy(key).applyInPandasWithState(count, f"{key} long, missing long", "missing long", "update", GroupStateTimeout.NoTimeout)


def settle(stream: DataFrame, keys: Sequence[str], *, mode: str = "update") -> DataFrame:
    """Run the stream over what there is, and return the last row of each key. Batches go to the shared folder."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = StructType([*stream.schema.fields, StructField("__batch", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("x")).select(*keys, "x.*") if others else rows.select(*keys).distinct()


def slices_in_order(rows: DataFrame, *, at: str, parts: int) -> list[DataFrame]:
    """rows in parts of consecutive times, cut at quantiles, so that all rows of one moment are in one part."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    ends = rows.select(micros.alias("m")).agg(F.percentile_approx("m", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = [None, *sorted(set(ends or [])), None]
    later = [rows if low is None else rows.where(micros > low) for low in cuts[:-1]]
    return [part if high is None else part.where(micros <= high) for part, high in zip(later, cuts[1:])]


def feed_in_order(rows: DataFrame, *, at: str, files: int) -> str:
    """A folder of the shared one with the rows in files of consecutive times, written one after another, as a feed comes."""
    path = f"{shared_folder(rows.sparkSession)}/feed-{uuid.uuid4().hex}"
    for part in slices_in_order(rows, at=at, parts=files):
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def run_to_end(stream: DataFrame, out: str) -> DataFrame:
    """Run the stream over what there is, from its checkpoint under `out` if there is one, and give all that it ever told."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)
