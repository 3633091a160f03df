"""A list that was saved page by page, as a Spark data source: one partition for each page.

The folder holds a folder `page=N` of JSON lines for each page, as a partitioned write leaves them; every line tells how many
pages there were. The first page is read for that number while the plan is made, and each page in a task of its own. A page
that isn't there, or has a line that is no JSON, is told as a row of that page with `error`; the others are read all the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _lines(path: str, page: int) -> list[str] | None:
    """The lines of a page's files, in order of their names; None if it isn't there."""
    store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True)) if re.search(r"/part-[^/]*\.json$", f.path)]
    if not files:
        return None
    return [line for f in sorted(files) for line in store.open_input_stream(f).read().decode().splitlines() if line]


@dataclass
class Page(InputPartition):
    number: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], [f.name for f in schema if f.name not in ("page", "error")]

    def partitions(self) -> list[Page]:
        first = _lines(self.path, 1)
        if not first:
            raise ValueError(f"{self.path} has no first page, which tells how many there are")
        return [Page(i) for i in range(1, int(json.loads(first[0])["total_pages"]) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        nothing = (None,) * len(self.columns)
        lines = _lines(self.path, partition.number)
        if lines is None:
            yield (partition.number, *nothing, "missing")
            return
        for line in lines:
            try:
                row = json.loads(line)
            except ValueError:
                yield (partition.number, *nothing, "no JSON")
                continue
            yield (partition.number, *(row.get(c) for c in self.columns), None)


class PagedSource(DataSource):
    """Columns: page, those asked for by the reader's schema, error."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, article long, title string, error string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def crawl(spark: SparkSession, path: str, columns: str = "article long, title string") -> DataFrame:
    """(page, columns, error) of all pages in the folder."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(f"page int, {columns}, error string").load(path)


def later_pages_win(rows: DataFrame, *, key: str) -> DataFrame:
    """Of the entries with one key that of the last page, and there the last in order of all values; errors stay as they are."""
    order = [F.col("page").desc(), *[F.col(c).desc_nulls_last() for c in rows.columns if c not in ("page", "error", key)]]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    last = rows.where("error IS NULL").withColumn("__place", place).where("__place = 1").drop("__place")
    return last.unionByName(rows.where("error IS NOT NULL"))
