"""Snapshots of a table with a hash tree over ranges of its keys, the difference of two, and what a guarded table forbids.

A snapshot's rows lie in folders by ranges of `WIDTH` * `FAN` keys. A leaf of the tree covers `WIDTH` keys and holds the hash
of its rows' hashes in order of key; a node above covers `FAN` nodes below, up to two or one at the top. Ranges are aligned to
multiples of their width, so that rows that are appended at new keys leave the nodes of all others as they were.

A difference starts at the top that both have and follows only nodes that differ; then it reads the folders of the differing leaves, and
no other. Of unchanged data nothing is read but the upper nodes of its tree.

Keys are whole numbers, unique and not null; a ValueError says if not. Columns are compared as JSON, so a change of type
alone that leaves the value's text is none; nulls are values.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators.lineage import cut, shared_folder

WIDTH, FAN = 1024, 16
#: Folders of differing leaves that the reader is told by name; beyond that a join chooses the rows.
NAMED = 4096


@dataclass(frozen=True)
class Snapshot:
    path: str
    key: str
    levels: int
    schema: StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def nodes(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/level={level}")


def _above(number: str, width: int) -> str:
    """SQL of the range of `width` numbers that a whole number lies in; exact, also for negative ones."""
    return f"({number} - pmod({number}, {width}L)) div {width}L"


def _combined(pairs: str) -> Column:
    """One hash of an array of (number, hash), in order of the numbers."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda v: F.concat_ws(":", v["number"].cast("string"), v["h"])), ","), 256).alias("h")


def write_snapshot(df: DataFrame, *, key: str, path: str | None = None, width: int = WIDTH) -> Snapshot:
    """The snapshot of df in a folder, of the shared one if path is None. The rows of a leaf, `width` at most, are hashed together."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    columns = sorted(df.columns)
    rows = df.withColumn("__leaf", F.expr(_above(f"CAST(`{key}` AS long)", width))).withColumn("__folder", F.expr(_above("__leaf", FAN)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "__leaf").sortWithinPartitions("__leaf", key).write.partitionBy("__folder").parquet(f"{path}/rows")
    # The folder's number is a partition column, which the reader puts last.
    schema = StructType([*(f for f in rows.schema if f.name != "__folder"), rows.schema["__folder"]])
    written = spark.read.schema(schema).parquet(f"{path}/rows")
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h")
    nodes = written.select(F.col("__leaf").alias("node"), F.struct(F.col(key).cast("long").alias("number"), one).alias("x")).groupBy("node").agg(
        F.collect_list("x").alias("x"), F.countDistinct("x.number").alias("d"))
    if not nodes.where("size(x) <> d OR node IS NULL").isEmpty():
        raise ValueError("keys of a snapshot have to be unique and not null")
    level, levels = nodes.select("node", _combined("x")), 0
    while True:
        level.write.parquet(f"{path}/level={levels}")
        level, levels = spark.read.parquet(f"{path}/level={levels}"), levels + 1
        # Nodes on both sides of zero never come together; there are two then.
        if level.count() <= 2:
            return Snapshot(path, key, levels, schema)
        level = level.select(F.expr(_above("node", FAN)).alias("above"), F.struct(F.col("node").alias("number"), "h").alias("x")).groupBy("above").agg(
            F.collect_list("x").alias("x")).select(F.col("above").alias("node"), _combined("x"))


def differing_leaves(spark: SparkSession, before: Snapshot, after: Snapshot) -> DataFrame:
    """(node) of the leaves that differ, are new or are gone, found from the top down."""
    top = min(before.levels, after.levels) - 1
    found = None
    for level in range(top, -1, -1):
        sides = [s.nodes(spark, level).withColumnRenamed("h", name) for s, name in ((before, "b"), (after, "a"))]
        if found is not None:
            sides = [df.withColumn("parent", F.expr(_above("node", FAN))).join(found.select(F.col("node").alias("parent")), "parent", "left_semi").drop("parent") for df in sides]
        found = cut(sides[0].join(sides[1], "node", "full").where("NOT (a <=> b)").select("node"))
    return found


def changes(spark: SparkSession, before: Snapshot, after: Snapshot) -> DataFrame:
    """(key, how, before, after) of the rows that were added, changed or deleted; before and after are structs of the row."""
    leaves = differing_leaves(spark, before, after)
    folders = leaves.select(F.expr(_above("node", FAN)).alias("folder")).distinct()
    named = [r[0] for r in folders.limit(NAMED + 1).collect()]

    def side(s: Snapshot, name: str) -> DataFrame:
        rows = s.rows(spark)
        if len(named) <= NAMED:
            rows = rows.where(F.col("__folder").isin(named))
        rows = rows.join(leaves.select(F.col("node").alias("__leaf")), "__leaf", "left_semi")
        columns = sorted(c for c in rows.columns if c not in ("__leaf", "__folder"))
        row = F.struct(*columns)
        return rows.select(F.col(s.key).alias("key"), row.alias(name), F.to_json(row, {"ignoreNullFields": "false"}).alias(f"{name}_json"))

    both = side(before, "before").join(side(after, "after"), "key", "full").where("NOT (before_json <=> after_json)")
    how = F.when(F.col("before_json").isNull(), "added").when(F.col("after_json").isNull(), "deleted").otherwise("changed")
    return both.select("key", how.alias("how"), "before", "after")


def guard_violations(
    changed: DataFrame, *, append_only: bool = False, sealed: str | None = None, identity: Sequence[str] = (), parent: str | None = None, finalized: DataFrame | None = None
) -> DataFrame:
    """(rule, key, how): what changes (of `changes`) break.

    append_only: rows are changed or deleted. sealed: rows are changed or deleted whose column of that name wasn't null before.
    identity: these columns are changed in a row that stays. parent, finalized: rows are added, changed or deleted that
    belong, or belonged, to a parent in `finalized` (id): a frozen collection takes no further child either.
    """
    old = F.col("how").isin("changed", "deleted")
    rules = []
    if append_only:
        rules.append(changed.where(old).select(F.lit("append_only").alias("rule"), "key", "how"))
    if sealed:
        rules.append(changed.where(old & F.col("before")[sealed].isNotNull()).select(F.lit("sealed").alias("rule"), "key", "how"))
    if identity:
        other = reduce(lambda a, b: a | b, [~F.col("before")[c].eqNullSafe(F.col("after")[c]) for c in identity])
        rules.append(changed.where((F.col("how") == "changed") & other).select(F.lit("identity").alias("rule"), "key", "how"))
    if parent and finalized is not None:
        owners = F.array_distinct(F.filter(F.array(F.col("before")[parent], F.col("after")[parent]), lambda x: x.isNotNull()))
        owned = changed.select("key", "how", F.explode(owners).alias("__owner"))
        frozen = owned.join(finalized.select(F.col("id").alias("__owner")), "__owner", "left_semi")
        rules.append(frozen.select(F.lit("frozen_child").alias("rule"), "key", "how").distinct())
    if not rules:
        raise ValueError("no rule is named")
    return reduce(DataFrame.unionByName, rules)
