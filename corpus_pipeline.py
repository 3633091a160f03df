"""The corpus pipeline: from raw documents to a deduplicated, decontaminated, mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of `documents`; the
last adds `copy`, the number of a document's copy in the mix. `run` applies them one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, line_dedup, mixing, quality_classifier, simhash
from palimpsest.llm.common import col, cut, table


#: Documents that go to a Python worker at once. A batch is held whole in the JVM and in the worker, long texts and all.
BATCH_ROWS = 512


def _small_batches(spark: SparkSession) -> None:
    """A setting of the session, because a stage is run after its function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of `like`, and n_chars, if there is one, counted anew."""
    names = {c.lower() for c in like.columns}
    if {"n_chars", "text"} <= names:
        kind = next(f.dataType for f in like.schema.fields if f.name.lower() == "n_chars")
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))
    return docs.select(*[col(c) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the stage's own documents."""
    _small_batches(spark)
    model = quality_classifier.fit_quality_classifier(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score_quality(docs, model, prefix="__").where("__predicted = 1").select(*map(col, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go from all documents but one; a document that this empties goes."""
    found = line_dedup.remove_spread_lines(docs, prefix="__")
    return _columns(found.where("__n_removed = 0 OR trim(text) <> ''"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the document of least id stays."""
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=5, at_least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which they are more than half goes."""
    _small_batches(spark)
    return _columns(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is sampled or repeated to its target."""
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]

#: SQL states neither the classifier nor the fingerprints; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder before the next reads them, so that no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if i else docs, sf_dir)
    return docs
