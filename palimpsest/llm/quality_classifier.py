"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each document gives the statistics in `STATISTICS`, transformed (logs of counts, square roots of shares) to be closer to
normal. Class sums, and sums of outer products, are aggregated by Spark over all labelled documents outside the held-out
fold, so fitting gathers two rows whatever the size. Each class covariance is shrunk towards the pooled one and that
towards its diagonal. A score is the logistic of the difference of log densities (half the Mahalanobis distances' and
log determinants' difference, from Cholesky factors computed once) and of the log prior odds, over a temperature which
tempers the confidence that correlated statistics inflate.

Cases. A null or empty text has all statistics at 0 and is scored like any other; a label other than 0 or 1, or null, is
not learned from; several labels of one id: the smallest counts; without both classes every score is the share of 1s (or
1 if nothing was learned: with no evidence nothing is rejected).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from palimpsest.llm import scan
from palimpsest.llm.common import SPACES, add_columns, col, cut, held_out
from palimpsest.llm.routing import maybe_in

STATISTICS = (
    "words", "bytes_per_word", "word_length_spread", "symbols", "marks", "upper", "digits", "lines_per_word", "bars",
    "repeated_lines", "repeated_words", "distinct_words",
)
SHRINK, DIAGONAL, TEMPERATURE, PRIOR = 0.2, 0.2, 4.0, 0.5
THRESHOLD = 0.3


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a block."""
    from palimpsest.llm.quality_rules import count_block

    words, counts = count_block(data, bounds)
    n, size = counts["n_words"], np.diff(bounds)
    lengths = (words.ends - words.starts).astype(float)
    total = scan.sums(lengths, words.bounds)
    per = np.maximum(n, 1)
    share = lambda letters: scan.sums(scan.class_table(letters, True)[data], bounds) / np.maximum(size, 1)
    mean = total / per
    spread = np.sqrt(np.maximum(scan.sums(lengths * lengths, words.bounds) / per - mean * mean, 0))
    own = words.owner().astype(np.uint64)
    distinct = np.unique(words.hashes() + own * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    kinds = np.bincount(words.owner()[distinct], minlength=len(n))
    columns = [
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.sqrt(share(b"#*$%&<>^~@{}[]\\")), np.sqrt(share(b"!?")),
        np.sqrt(share(bytes(range(65, 91)))), np.sqrt(share(b"0123456789")), np.sqrt(share(b"\n") * size / per), np.sqrt(share(b"|")),
        np.sqrt(counts["n_dup_lines"] / np.maximum(share(b"\n") * size + 1, 1)), np.sqrt(counts["n_repeat_words"] / per),
        np.sqrt(kinds / per),
    ]
    return np.stack(columns, axis=1)


def add_statistics(docs: DataFrame, *, text: str = "text", into: str = "statistics") -> DataFrame:
    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            parts = [statistics(data, bounds) for _, _, data, bounds in scan.blocks(texts)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            return [scan.as_list(pa.array(x.ravel()), np.full(len(x), len(STATISTICS)))]

        return compute

    return add_columns(docs, text, [StructField(into, ArrayType(DoubleType()))], make)


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants by class; `share` where a class is missing."""

    means: np.ndarray | None
    factors: np.ndarray | None
    log_dets: np.ndarray | None
    share: float
    temperature: float = TEMPERATURE
    prior: float = PRIOR

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        z = (density[1] - density[0]) / self.temperature + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, *, shrink: float = SHRINK, diagonal: float = DIAGONAL, **options) -> Model:
    """From each class's count, sum of statistics and sum of outer products."""
    if not counts.all():
        return Model(None, None, None, float(counts[1] / counts.sum()) if counts.sum() else 1.0, **options)
    means = sums / counts[:, None]
    covariances = [p / n - np.outer(m, m) for p, n, m in zip(products, counts, means)]
    pooled = sum(n * c for n, c in zip(counts, covariances)) / counts.sum()
    ridge = 1e-4 * np.eye(len(pooled))
    target = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + ridge
    factors = [np.linalg.cholesky((1 - shrink) * c + shrink * target) for c in covariances]
    return Model(
        means, np.stack([np.linalg.inv(f) for f in factors]),
        np.array([2 * np.log(np.diag(f)).sum() for f in factors]), float(counts[1] / counts.sum()), **options,
    )


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", value: str = "quality", **options) -> Model:
    """A model from all labelled documents outside the held-out fold; the sums are formed in the tasks and by Spark."""
    d = len(STATISTICS)
    known = labels.select(col(doc_id).alias("__id"), col(value).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    known = cut(known.where(~held_out("__id")).groupBy("__id").agg(F.min("__label").alias("__label")))
    # Only texts that may have a label are measured; they are found by a table of bounded size, so no text is shuffled.
    key = F.col("__id").cast("string").alias("__key")
    texts = docs.select(col(doc_id).alias("__id"), col(text).alias("__body")).where("__id IS NOT NULL").select("*", key)
    stats = add_statistics(maybe_in(texts, known.select(key), "__key"), text="__body")
    rows = stats.select("__id", "statistics").join(known, "__id").select("__label", "statistics")

    def totals(batches):
        count, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                part = x[label == c]
                count[c] += len(part)
                total[c] += part.sum(axis=0)
                product[c] += part.T @ part
        for c in (0, 1):
            values = np.r_[count[c], total[c], product[c].ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), c), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["label", "at", "value"])

    sums = rows.mapInArrow(totals, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    found = np.zeros((2, 1 + d + d * d))
    for r in sums:
        found[r["label"], r["at"]] = r["value"]
    return fit(found[:, 0], found[:, 1 : 1 + d], found[:, 1 + d :].reshape(2, d, d), **options)


def score_quality(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with score and predicted (1 if score >= threshold), their names after `prefix`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            parts = [m.scores(statistics(data, bounds)) for _, _, data, bounds in scan.blocks(texts)]
            return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

        return compute

    scored = add_columns(docs, text, [StructField(f"{prefix}score", DoubleType())], make)
    return scored.withColumn(f"{prefix}predicted", F.when(F.col(f"{prefix}score") >= threshold, 1).otherwise(0))
