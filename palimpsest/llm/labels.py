"""Bounded, labelled training samples for the classifiers.

A sample is picked by a hash against a threshold that is set from a count, so that no task gathers candidates. `limit`
bounds its rows and `budget` its bytes: of the rows picked, those of least hash whose texts fit the budget together are
taken, whole, never cut; a text of over a quarter of the budget isn't taken. Only models are fitted on samples; documents
are scored whole, and all of them. Null texts aren't learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import col, held_out

_STEPS = 1 << 20


def _place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(_STEPS)).cast("int")


def _picked(place: Column, limit: int, total: int) -> Column:
    return place < F.lit(int(_STEPS * min(1.0, 0.95 * limit / max(1, total))) + 1)


def _within(rows: DataFrame, limit: int, budget: int) -> list[tuple[str, object]]:
    """(text, label) of the picked rows (place, text, label) of least place that keep to both bounds."""
    sizes = rows.select("place", F.octet_length("text").alias("n")).where(F.col("n") <= budget // 4)
    left, last = budget, -1
    for r in sorted(sizes.limit(2 * limit).collect()):
        left -= r["n"]
        if left < 0:
            break
        last = r["place"]
    taken = rows.where((F.col("place") <= last) & (F.octet_length("text") <= budget // 4))
    return [(r["text"], r["label"]) for r in taken.select("text", "label").limit(limit).collect()]


def sample_of(docs: DataFrame, label: Column, *, text: str, doc_id: str, limit: int, budget: int) -> list[tuple[str, object]]:
    """(text, label) of at most `limit` rows with a label, outside the held-out fold, of at most `budget` bytes."""
    rows = docs.select(col(doc_id).alias("id"), col(text).alias("text"), label.alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    total = rows.count()
    # Rows of one id are told apart by their texts, so that they are not taken or left together.
    return _within(rows.withColumn("place", _place("id", "text")).where(_picked(F.col("place"), limit, total)), limit, budget)


def sample_with(docs: DataFrame, labels: DataFrame, value: str, *, text: str, doc_id: str, limit: int, budget: int) -> list[tuple[str, object]]:
    """(text, label) of at most `limit` labelled documents outside the held-out fold, of at most `budget` bytes.

    The ids are picked from the labels, so that texts are neither sorted nor shuffled: at most `limit` ids are broadcast.
    Of several labels of one id the smallest counts; null ones and null ids don't.
    """
    known = labels.select(col(doc_id).alias("id"), col(value).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    ids = known.where(_picked(_place("id"), limit, known.count())).limit(limit)
    rows = docs.select(col(doc_id).alias("id"), col(text).alias("text")).where("text IS NOT NULL")
    return _within(rows.join(F.broadcast(ids), "id").withColumn("place", _place("id", "text")), limit, budget)
