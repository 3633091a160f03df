"""Hard negatives for anchors among all vectors, by exact whole-number scores in the Four-Russians way.

Components become whole numbers floor(scale * x). A row's bits are packed once: for each bit plane of the two's complement
and each group of eight dimensions one byte. For each block of anchors and each group the sums of all 256 subsets of an
anchor's eight components are tabled. A score is then looked up, not multiplied: the groups' sums of a plane are added, the
planes are shifted and added from the sign plane down. The result is the exact inner product.

Every row is packed where it is read, in blocks of `ROWS`, and written; anchors are packed in blocks of about `ANCHORS`. The
stated set of anchors meets all rows block by block: a record of the join is a pair of blocks, and Spark broadcasts the
anchors' side only while it is small. Two passes over the blocks: the first scores rows of an anchor's own label and keeps
the best `positives`; the second scores the others against the ranges that those leave. A task keeps no more than the best
of each anchor and positive it has met, and these are ranked over all tasks. Nothing passes the driver but one count.

Order: higher scores first, ties by smaller id. Negatives of a positive are the first `negatives` of another label whose
score is at least `least` and at most `most` hundredths of the positive's score; hence there are none if that is negative.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors are
padded with zeros, so an empty one scores 0; repeated rows are rows of their own, but none with the anchor's id is among its
partners, and of several anchors with one id the one of least label and vector counts; an anchor without rows of its label,
or without rows in range, gives no rows; scores that might exceed 2 ** 56 are a ValueError; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import col, cut

SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 3, 50, 95
#: Rows and anchors of a block; a pair of full blocks of 64 dimensions is under a megabyte.
ROWS, ANCHORS = 4096, 512
#: The rows that a task keeps before it ranks them.
KEPT = 1 << 17
_BITS = 56


@contextmanager
def _records_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """While it holds, n records at most go to Python at once: a pair of blocks is a large record."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """(rows, dimensions) of floor(scale * x), padded with zeros to a multiple of eight."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(x) and np.abs(x).max() >= 1 << _BITS:
        raise ValueError(f"scores may exceed 2 ** {_BITS}")
    out = np.zeros((len(sizes), -(-max(sizes.max(initial=0), 1) // 8) * 8), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = x.astype(np.int64)
    return out


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) of bytes: the bits of each eight dimensions, the last plane being the sign's."""
    planes = int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length() + 1
    bits = ((x >> np.arange(planes)[:, None, None]) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits.reshape(planes, len(x), -1, 8), axis=3)[..., 0].swapaxes(1, 2))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each byte the sum of the components whose bits it has, in the least type that holds all."""
    bound = int(np.abs(anchors).sum(axis=1).max(initial=0))
    kind = np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64
    groups = anchors.T.reshape(-1, 8, len(anchors)).astype(kind)
    out = np.zeros((len(groups), 1, len(anchors)), kind)
    for j in range(7, -1, -1):
        out = np.concatenate([out, out + groups[:, j : j + 1]], axis=1)
    return out


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products, from the anchors' subset sums and the rows' planes."""
    n_planes, groups, rows = planes.shape
    groups, anchors = min(groups, len(sums)), sums.shape[2]  # dimensions that one side lacks are zero
    bound = int(np.abs(sums[:groups].astype(np.int64)).max(axis=1).sum(axis=0).max(initial=0)) << n_planes
    if bound >= 1 << (_BITS + 1):
        raise ValueError(f"scores may exceed 2 ** {_BITS}")
    out = np.empty((rows, anchors), np.int32 if bound < 1 << 31 else np.int64)
    step = max(8, (1 << 16) // max(anchors, 1))  # what is added to stays in the cache
    found = np.empty((step, anchors), sums.dtype)
    for a in range(0, rows, step):
        part = out[a : a + step]
        part[:] = 0
        some = found[: len(part)]
        for k in range(n_planes - 1, -1, -1):
            plane = np.take(sums[0], planes[k, 0, a : a + step], axis=0)
            for g in range(1, groups):
                np.take(sums[g], planes[k, g, a : a + step], axis=0, out=some, mode="clip")
                plane += some
            part += part
            part += -plane if k == n_planes - 1 else plane
    return out


def first_of_each(key: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` of each key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    start = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < top]


_ROW_BLOCK = "ids binary, labels binary, planes binary, n_planes int, rows int"
_ANCHOR_BLOCK = "block long, a_ids binary, a_labels binary, a_values binary, anchors int, a_slots binary, a_low binary, a_high binary"
_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _row_blocks(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """The packed rows, in blocks, in the order of their ids within each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, size):
                batch = whole.slice(a, size)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                planes = bit_planes(whole_numbers(batch.column(2), scale)[order])
                values = [ids[order].astype(np.int64).tobytes(), batch.column(1).to_numpy(zero_copy_only=False)[order].astype(np.int64).tobytes(), planes.tobytes()]
                columns = [pa.array([v], pa.binary()) for v in values] + [pa.array([v], pa.int32()) for v in (len(planes), len(ids))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "planes", "n_planes", "rows"])

    return cut(rows.mapInArrow(pack, _ROW_BLOCK))


def _anchor_blocks(anchors: DataFrame, scale: int, n: int) -> DataFrame:
    """anchors (id, label, v, slots: array of (low, high)) in n blocks."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        values, slots = whole_numbers(group.column("v").combine_chunks(), scale), group.column("slots").to_pylist()
        counts = np.array([len(s) for s in slots], np.int64)
        ends = np.array([[(x["low"], x["high"]) for x in s] + [(1, 0)] * (counts.max(initial=0) - len(s)) for s in slots], np.int64).reshape(len(slots), -1, 2)
        parts = [group.column(c).to_numpy().astype(np.int64) for c in ("id", "label")] + [values]
        out = [group.column("block")[:1].combine_chunks()] + [pa.array([p.tobytes()], pa.binary()) for p in parts] + [pa.array([len(values)], pa.int32())]
        out += [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in (counts, ends[..., 0], ends[..., 1])]
        return pa.table(out, names=["block", "a_ids", "a_labels", "a_values", "anchors", "a_slots", "a_low", "a_high"])

    return cut(anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("block").applyInArrow(pack, _ANCHOR_BLOCK))


def _own_label(sums, a_ids, a_labels, ids, labels, planes, top: int):
    """(anchor, slot 0, row) of the best rows of each anchor's label."""
    for label in np.intersect1d(a_labels, labels):
        mine, rows = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        s = scores(np.ascontiguousarray(sums[:, :, mine]), planes[:, :, rows]).T
        others = a_ids[mine, None] != ids[rows]
        if len(rows) > top + 1:
            # One of the rows may be the anchor, so one more than asked for.
            others &= s >= -np.partition(-s, top, axis=1)[:, top : top + 1]
        a, r = np.nonzero(others)
        yield mine[a], np.zeros(len(a), np.int32), rows[r], s[a, r]


def _in_range(sums, a_ids, a_labels, ids, labels, planes, low: np.ndarray, high: np.ndarray):
    """(anchor, slot, row) of the rows of other labels within each anchor's ranges; an empty range has low over high."""
    if low.shape[1]:
        s = scores(sums, planes)
        some = low <= high
        least = np.where(some, low, 1 << 62).min(axis=1)
        greatest = np.where(some, high, -(1 << 62)).max(axis=1)
        r, a = np.nonzero((s >= least) & (s <= greatest) & (labels[:, None] != a_labels) & (ids[:, None] != a_ids))
        x = s[r, a]
        for slot in range(low.shape[1]):
            fits = (x >= low[a, slot]) & (x <= high[a, slot])
            yield a[fits], np.full(fits.sum(), slot, np.int32), r[fits], x[fits]


def _meet(blocks: DataFrame, anchors: DataFrame, top: int, ranges: bool) -> DataFrame:
    """(anchor, slot, id, score), the `top` of each anchor and slot over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kept, size = {}, [], 0

        def reduced(parts: list) -> tuple:
            anchor, slot, ids, score = (np.concatenate(c) for c in zip(*parts))
            place = np.unique(anchor, return_inverse=True)[1].ravel()
            best = first_of_each(place * (slot.max(initial=0) + 1) + slot, score, ids, top)
            return anchor[best], slot[best], ids[best], score[best]

        def told(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(reduced(parts), _FOUND)], schema=_FOUND)

        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, batch=batch, i=i: batch.column(batch.schema.get_field_index(name))[i]
                numbers = lambda name, get=get: np.frombuffer(get(name).as_buffer(), np.int64)
                block = get("block").as_py()
                a_ids, a_labels, counts = numbers("a_ids"), numbers("a_labels"), numbers("a_slots")
                if block not in tables:
                    if len(tables) == 4:
                        tables.pop(next(iter(tables)))
                    tables[block] = subset_sums(numbers("a_values").reshape(len(a_ids), -1))
                ids, labels = numbers("ids"), numbers("labels")
                planes = np.frombuffer(get("planes").as_buffer(), np.uint8).reshape(get("n_planes").as_py(), -1, len(ids))
                if ranges:
                    low, high = (numbers(c).reshape(len(a_ids), -1) if counts.any() else np.zeros((len(a_ids), 0), np.int64) for c in ("a_low", "a_high"))
                    found = _in_range(tables[block], a_ids, a_labels, ids, labels, planes, low, high)
                else:
                    found = _own_label(tables[block], a_ids, a_labels, ids, labels, planes, top)
                for a, slot, r, x in found:
                    kept.append(reduced([(a_ids[a], slot.astype(np.int64), ids[r], x.astype(np.int64))]))
                    size += len(kept[-1][0])
                if size > KEPT:
                    kept = [reduced(kept)]
                    size = len(kept[0][0])
                if size > KEPT // 2:
                    yield told(kept)
                    kept, size = [], 0
        if kept:
            yield told(kept)

    met = blocks.crossJoin(anchors).mapInArrow(run, "anchor long, slot int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id"))
    with _records_per_batch(blocks.sparkSession, 16):
        return cut(met.withColumn("rank", rank).where(F.col("rank") <= top))


def mine_hard_negatives(
    vectors: DataFrame, asked: Column, *, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `asked` holds.

    Sizes of blocks don't change the result.
    """
    named = col(label) if isinstance(label, str) else label
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(col(key).cast("long").alias("id"), named.cast("long").alias("label"), col(vector).cast("array<double>").alias("v"), asked.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    blocks = _row_blocks(rows.select("id", "label", "v"), scale, rows_per_block)
    anchors = cut(rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    n = max(1, -(-anchors.count() // anchors_per_block))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    best = _meet(blocks, _anchor_blocks(anchors.withColumn("slots", none), scale, n), positives, ranges=False)
    hundredths = lambda times, sign: f"(({sign}score * {times}) - pmod({sign}score * {times}, 100L)) div 100L"
    low, high = -F.expr(hundredths(least, "-")), F.expr(hundredths(most, ""))
    ranges = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("x"))
    slots = F.transform("x", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high")))
    asked_for = anchors.join(ranges, F.col("id") == F.col("anchor")).select("id", "label", "v", slots.alias("slots"))
    found = _meet(blocks, _anchor_blocks(asked_for, scale, n), negatives, ranges=True)
    # A range stands at the place of its positive, whose rank is one more.
    of = best.select(F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.join(of, (F.col("anchor") == F.col("anchor_id")) & (F.col("slot") == F.col("of")))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
