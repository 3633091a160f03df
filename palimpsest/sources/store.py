"""Content-addressed storage of bytes, type sniffing and rules for fetched addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bytes of file formats, as hex.
MAGIC = {
    "pdf": "25504446", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1",
}


def addressed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with sha and path; one row for each content."""
    sha = F.sha2(F.col(content), 256)
    path = F.concat(F.lit("sha256/"), F.substring("sha", 1, 2), F.lit("/"), F.substring("sha", 3, 2), F.lit("/"), F.col("sha"))
    return files.withColumn("sha", sha).dropDuplicates(["sha"]).withColumn("path", path)


def put(files: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """Append contents that the store doesn't hold yet, as a table of (sha, path, content); returns what was added."""
    spark = files.sparkSession
    new = addressed(files.select(F.col(content).alias("content"))).select("sha", "path", "content")
    try:
        held = spark.read.parquet(folder).select("sha")
    except Exception as error:  # a store that isn't there yet holds nothing
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        new = new.join(held, "sha", "left_anti")
    new.write.mode("append").parquet(folder)
    return new


def get(store: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """(key, content, found) for each of keys: what the store holds there, null where it holds nothing."""
    held = store.select(F.col("path").alias("__path"), "content")
    joined = keys.select(key).join(held, F.col(key) == F.col("__path"), "left")
    return joined.select(key, "content", F.col("__path").isNotNull().alias("found"))


def verify(store: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(sha, path, problem) of contents that don't have the hash that addresses them.

    With objects (sha, size), what the records say is stored, also those that are missing or of another size.
    """
    bad = F.sha2("content", 256) != F.col("sha")
    if objects is None:
        return store.where(bad).select("sha", "path", F.lit("hash").alias("problem"))
    told = objects.select(F.col("sha").alias("__sha"), F.col("size").alias("__size")).distinct()
    both = store.join(told, F.col("sha") == F.col("__sha"), "full")
    problem = F.when(F.col("sha").isNull(), "missing").when(bad, "hash").when(F.octet_length("content") != F.col("__size"), "size")
    return both.select(F.coalesce("sha", "__sha").alias("sha"), "path", problem.alias("problem")).where("problem IS NOT NULL")


#: Entries by which a ZIP archive is told to be a document: all of them, the last as a folder's beginning.
ZIPPED = {
    "hwpx": ("mimetype", "Contents/content.hpf"), "docx": ("[Content_Types].xml", "word/"), "xlsx": ("[Content_Types].xml", "xl/"),
    "pptx": ("[Content_Types].xml", "ppt/"),
}
#: Streams and storages by which a compound file is told to be a document: all of one of the sets.
COMPOUND = {"hwp": (("FileHeader", "BodyText"),), "doc": (("WordDocument",),), "xls": (("Workbook",), ("Book",))}


def _container(content: Column, kind: Column) -> Column:
    """The document's format where kind is zip or ole, by the names in its directory; binary for a ZIP without one."""
    text = F.decode(content, "ISO-8859-1")
    # A name in a ZIP's central directory stands 46 bytes behind its entry's start; a compound file's is UTF-16 with a null at its end.
    entry = lambda name: F.contains(text, F.lit("PK\x01\x02")) & F.rlike(text, F.lit(r"(?s)PK\x01\x02.{42}\Q" + name + r"\E"))
    stream = lambda name: F.contains(text, F.lit("".join(c + "\0" for c in name) + "\0\0"))
    every = lambda found: reduce(lambda a, b: a & b, found)
    zipped = F.when(~F.contains(text, F.lit("PK\x05\x06")), "binary")
    for name, entries in ZIPPED.items():
        zipped = zipped.when(every([entry(e) for e in entries]), name)
    ole = F.when(F.lit(False), "")
    for name, sets in COMPOUND.items():
        for streams in sets:
            ole = ole.when(every([stream(s) for s in streams]), name)
    return F.when(kind == "zip", F.coalesce(zipped, F.lit("zip"))).when(kind == "ole", F.coalesce(ole, F.lit("ole"))).otherwise(kind)


def sniff(content: Column, name: Column) -> Column:
    """(format, confidence): leading bytes first, and what is in a container; then HTML's beginning, the name's ending, else binary."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.when(F.lit(False), F.lit(""))
    for kind, magic in MAGIC.items():
        found = found.when(F.startswith(head, F.lit(magic)), kind)
    found = _container(content, found)
    start = F.lower(F.ltrim(F.decode(F.substring(content, 1, 256), "ISO-8859-1")))
    html = F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html"))
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.struct(
        F.coalesce(found, F.when(html, "html"), F.nullif(ending, F.lit("")), F.lit("binary")).alias("format"),
        F.when(found.isNotNull(), "magic").when(html, "prefix").when(ending != "", "extension").otherwise("none").alias("confidence"))


def fetchable(url: Column) -> Column:
    """http or https, a public host name or address, no credentials and no port but the usual ones."""
    host, scheme = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    inner = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.)|\.(local|internal)$")
    user = F.try_parse_url(url, F.lit("USERINFO"))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)$", 1)
    return F.coalesce(scheme.isin("http", "https") & host.isNotNull() & ~inner & user.isNull() & port.isin("", "80", "443"), F.lit(False))
