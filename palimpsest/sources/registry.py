"""Saved files: which format each one is, and which parser takes it; parsers themselves plug in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.store import sniff

#: Formats that a parser of their own takes first, and the flag of its failure; then the format's direct parser follows.
PREFERRED = {"pdf": ("pdf_hybrid", "pdf_hybrid_failed"), "hwp": ("hwp_pdf", "rhwp_failed"), "hwpx": ("hwp_pdf", "rhwp_failed"),
             "docx": ("docling", "docling_failed"), "xlsx": ("docling", "docling_failed"), "pptx": ("docling", "docling_failed")}
#: Formats with a direct parser, and those that are taken apart.
DIRECT, ARCHIVES = ("html", "pdf", "png", "jpeg", "gif", "docx", "doc", "hwpx", "hwp", "xlsx", "xls", "pptx"), ("zip",)


def save_each(rows: DataFrame, folder: str, *, name: str, content: str) -> None:
    """Each row's content as a file of its own under folder, in one of 256 folders by a hash of its name; names have to differ.

    A task writes its files where they stay, so no file is moved when the job ends, and a task that runs again writes the
    same files.
    """
    place = F.concat_ws("/", F.lpad(F.hex(F.pmod(F.xxhash64(name), F.lit(256))), 2, "0"), F.col(name))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        made = set()
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (parent := path.split("/")[0]) not in made:
                    store.create_dir(f"{root}/{parent}", recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(value or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select(place.alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def scan_saved(spark: SparkSession, folder: str, *, names: str = "*") -> DataFrame:
    """(path, length, sha, format, confidence) of the files under folder whose names match the glob `names`.

    Files of other names aren't opened. A file is a row, so it has to fit into a task's memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    kind = sniff(F.col("content"), F.col("path"))
    return files.select("path", "length", F.sha2("content", 256).alias("sha"), kind.alias("kind")).select("path", "length", "sha", "kind.format", "kind.confidence")


def _preferred(kind: Column, place: int) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for name, values in PREFERRED.items():
        found = found.when(kind == name, values[place])
    return found


def routed(files: DataFrame, failures: DataFrame, *, key: str) -> DataFrame:
    """files with parser, status and flags: who takes each by its `format`, given who failed.

    failures: (key, parser, error), parser a preferred one's name or direct. A file whose preferred parser failed is taken by
    the direct one: partial, flagged with what failed and how. If that failed too, or was first, the file is failed. A format
    without a parser is unsupported, and says which.
    """
    kind = F.col("format")
    errors = failures.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("parser", "error"))).alias("__errors"))
    both = files.join(errors, F.col(key) == F.col("__key"), "left")
    error = lambda parser: F.try_element_at("__errors", parser)
    first, direct = _preferred(kind, 0), kind.isin(*DIRECT)
    broken = F.when(first.isNotNull() & error(first).isNotNull(), F.concat_ws(":", _preferred(kind, 1), error(first)))
    fallback = broken.isNotNull() | first.isNull()
    failed = direct & fallback & error(F.lit("direct")).isNotNull()
    parser = F.when(kind.isin(*ARCHIVES), "archive").when(first.isNotNull() & broken.isNull(), first).when(direct, "direct").otherwise("unsupported")
    status = F.when(parser == "unsupported", "unsupported").when(failed, "failed").when(broken.isNotNull(), "partial").otherwise("succeeded")
    flags = F.array_compact(F.array(broken, F.when(failed, F.concat(F.lit("direct_failed:"), error(F.lit("direct")))), F.when(parser == "unsupported", F.concat(F.lit("unsupported:"), kind))))
    return both.select(*[F.col(c) for c in files.columns], parser.alias("parser"), status.alias("status"), flags.alias("flags"))
