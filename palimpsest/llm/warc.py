"""WARC archives as a Spark data source, and pages written to them with payloads stored once.

`WarcSource` ("warc" to `spark.read.format` and `df.write.format`) is a Python data source over any store that Arrow's file
systems reach (local and shared folders, S3, GCS, HDFS).

Reading. The plan is files: those of the folder's commit lists (else all *.warc and *.warc.gz of it), packed into
partitions of `partition_bytes`, one file at least. The columns are those of the schema that the reader is given, any of
`COLUMNS`. Predicates on record type and other headers are pushed down and judged on a record's header lines, which come
first; a record that fails them, and any payload if the schema has no column for it, is passed over: in a plain file by
seeking, in a gzip member that tells its length (subfield `sl`) by seeking too, else by inflating without keeping. Pushdown
needs spark.sql.python.filterPushdown.enabled, which `register` sets; without it Spark refuses the reader. A payload that
is read is held against its digest. A file that breaks off, or is none, is a ValueError with its name and the offset.

Writing. One file for each task, a new one after `file_bytes`; each record a gzip member of its own. A job's files count
once its commit list is written, so that tasks that failed or ran twice leave nothing behind that a reader takes.

`write_pages` writes a response for the least page of each distinct payload and revisits, which have the headers but no
payload, for the others. Payloads are told apart by SHA-256. Only the digests are grouped; pages themselves move only if
they meet groups of more than one row, and then by a join that Spark splits or broadcasts as it sees fit.

Cases: null html: an empty payload; payloads under `min_bytes` (0) are responses always; null page_id: a record without a
number, last in its group; repeated rows: one is the response, the others revisit it, rows of equal page_id and payload in
order of url; null url: no target; white space and control characters in a url are percent-encoded; an empty table:
no archive, and no rows; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from palimpsest.llm.common import col, cut, shared_folder

COLUMNS = (
    "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, content_type string, "
    "content_bytes long, payload_bytes long, headers map<string,string>, payload binary")
#: What a writer takes, by name; the payload of a revisit is digested and left out.
WRITTEN = "record_type string, record_id string, target_uri string, refers_to string, payload binary"
#: What each header line gives, and the profile of a revisit.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest", "content_type": "content-type", "content_bytes": "content-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
PUSHED = "spark.sql.python.filterPushdown.enabled"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


class Stream:
    """Bytes of a file from front to back.

    member: (start, length, inflated length) of the gzip member that was begun last, if it tells them; fresh: whether the
    record whose header lines were read last began with that member.
    """

    def __init__(self, file, name: str):
        self.file, self.name = io.BufferedReader(file, 1 << 18), name
        self.plain = self.file.peek(2)[:2] != b"\x1f\x8b"
        self.kept, self.inflater, self.member, self.fresh, self.given = b"", None, None, False, 0

    def _more(self) -> bool:
        """Some more bytes in `kept`; False at the end of the file."""
        if self.plain:
            data = self.file.read(1 << 13)
            self.kept += data
            return bool(data)
        while True:
            if self.inflater is None:
                start = self.file.tell()
                head = self.file.read(12)
                if not head:
                    return False
                extra = self.file.read(struct.unpack("<H", head[10:])[0]) if len(head) == 12 and head[3] & 4 else b""
                self.member = (start, *struct.unpack("<II", extra[4:12])) if extra[:4] == b"sl\x08\x00" else None
                self.file.seek(start)
                self.inflater, self.given = zlib.decompressobj(31), 0
            data = self.inflater.unconsumed_tail or self.file.read(1 << 12)
            try:
                out = self.inflater.decompress(data, 1 << 16 if self.given else 1 << 10)  # header lines first
            except zlib.error as error:
                raise ValueError(f"{self.name}: no gzip member before byte {self.file.tell()}: {error}") from error
            if self.inflater.eof:
                self.file.seek(-len(self.inflater.unused_data), 1)
                self.inflater = None
            elif not data:
                raise ValueError(f"{self.name}: ends within a gzip member")
            if out:
                self.kept, self.given = self.kept + out, self.given + len(out)
                return True

    def head(self, most: int = 1 << 20) -> bytes | None:
        """Header lines up to an empty one; None at the end of the file. Line ends left over between records are skipped."""
        while True:
            self.kept = self.kept.lstrip(b"\r\n")
            if not self.kept:
                self.fresh = self.inflater is None
            if (at := self.kept.find(END)) >= 0:
                found, self.kept = self.kept[:at], self.kept[at + 4 :]
                return found
            if len(self.kept) > most:
                raise ValueError(f"{self.name}: header lines of over {most} bytes before byte {self.file.tell()}")
            if not self._more():
                if self.kept:
                    raise ValueError(f"{self.name}: ends within header lines")
                return None

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.kept and not self._more():
                raise ValueError(f"{self.name}: ends within a record")
            part, self.kept = self.kept[:left], self.kept[left:]
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    def skip(self, n: int, record: int) -> None:
        """Past n bytes; record: the length of the whole record, whose header lines were just read."""
        if n and self.fresh and self.inflater is not None and self.member and self.member[2] == record:
            self.file.seek(self.member[0] + self.member[1])
            self.kept, self.inflater, self.member = b"", None, None
            return
        part = min(n, len(self.kept))
        self.kept, n = self.kept[part:], n - part
        if n and self.plain:
            self.file.seek(n, 1)
            return
        while n:
            if not self._more():
                raise ValueError(f"{self.name}: ends within a record")
            part = min(n, len(self.kept))
            self.kept, n = self.kept[part:], n - part


def _lines(head: bytes, name: str) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on with the one before."""
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n")
    if not first.startswith((b"WARC/", b"HTTP/")):
        raise ValueError(f"{name}: a record begins with {first[:40]!r}")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _bare(name: str, value: str | None):
    """A header's value as the column has it: ids without brackets, digests without their algorithm, lengths as numbers."""
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    if name == "payload_digest":
        return value.removeprefix("sha1:")
    return int(value) if name == "content_bytes" else value


def records(stream: Stream, columns: list[str], keep: Callable[[dict], bool]) -> Iterator[tuple]:
    """The wanted columns of the records that `keep` takes, judged by their WARC headers."""
    inside, whole = {"payload", "payload_bytes"} & set(columns), "payload" in columns
    while (head := stream.head()) is not None:
        lines = _lines(head, stream.name)
        row = {c: _bare(c, lines.get(h)) for c, h in HEADERS.items()}
        n = row["content_bytes"] or 0
        record = len(head) + 4 + n + 4
        if not keep(row):
            stream.skip(n, record)
            continue
        if inside:
            http, block = (row["content_type"] or "").startswith("application/http"), stream.read(n) if whole else b""
            while http and END not in block and len(block) < n:
                block += stream.read(min(1 << 12, n - len(block)))
            stream.skip(n - len(block), record)
            start = block.find(END) + 4 if http and END in block else 0
            said = _lines(block[: start - 4], stream.name).get("content-length") if start else None
            row["payload_bytes"] = int(said) if row["record_type"] == "revisit" and said is not None else n - start
            if whole and row["record_type"] != "revisit":
                row["payload"] = block[start:]
                if (lines.get("warc-payload-digest") or "").startswith("sha1:") and payload_digest(row["payload"]) != row["payload_digest"]:
                    raise ValueError(f"{stream.name}: the payload of {row['record_id']} differs from its digest")
        else:
            stream.skip(n, record)
        row["headers"] = list(lines.items())
        yield tuple(row.get(c) for c in columns)


#: Filters on one column that a record's headers decide.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda a, f: a is not None and a == f.value, In: lambda a, f: a is not None and a in f.value, IsNull: lambda a, f: a is None,
    IsNotNull: lambda a, f: a is not None, StringStartsWith: lambda a, f: a is not None and a.startswith(f.value), GreaterThan: lambda a, f: a is not None and a > f.value,
    GreaterThanOrEqual: lambda a, f: a is not None and a >= f.value, LessThan: lambda a, f: a is not None and a < f.value, LessThanOrEqual: lambda a, f: a is not None and a <= f.value}


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.filters = options["path"], schema, []
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS and getattr(f, "value", 0) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.File:
            files = [found]
        else:
            lists = store.get_file_info(fs.FileSelector(f"{path}/_committed", allow_not_found=True))
            names = {f"{path}/{n}" for x in lists for n in store.open_input_stream(x.path).read().decode().split()}
            inside = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
            files = [x for x in inside if (x.path in names if lists else re.search(r"\.warc(\.gz)?$", x.path))]
        parts, room = [], 0
        for x in sorted(files, key=lambda x: x.path):
            if not parts or x.size > room:
                parts.append(Files([]))
                room = self.partition_bytes
            parts[-1].paths.append(x.path)
            room -= x.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, columns, schema = _store(self.path)[0], self.schema.names, to_arrow_schema(self.schema)
        tests = [(_TESTS[type(f)], f.attribute[0], f) for f in self.filters]
        keep = lambda row: all(test(row[c], f) for test, c, f in tests)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(schema)], schema=schema)
        at = columns.index("payload") if "payload" in columns else None
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in records(Stream(file, path), columns, keep):
                    rows.append(row)
                    size += 256 + (len(row[at] or b"") if at is not None else 0)
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def record_bytes(kind: str, record_id: str, target: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """A response or revisit of an HTTP answer with this payload; a revisit has its headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if target is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(record: bytes, level: int) -> bytes:
    """A gzip member that tells its own and the record's length in the subfield `sl` of its header."""
    deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflater.compress(record) + deflater.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        if missing := {"record_type", "record_id", "target_uri", "refers_to", "payload"} - set(schema.names):
            raise ValueError(f"to write WARC takes the columns {WRITTEN}; missing: {', '.join(sorted(missing))}")
        self.path, self.level, self.file_bytes = options["path"], int(options.get("level", 4)), int(options.get("file_bytes", 1 << 28))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        names, file, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload")]
            for i in range(batch.num_rows):
                kind, key, target, refers_to, payload = (c[i].as_py() for c in columns)
                if file is None:
                    store.create_dir(path, recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = member(record_bytes(kind, key, target, refers_to, payload or b""), self.level)
                file.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(f"{path}/_committed", recursive=True)
        with store.open_output_stream(f"{path}/_committed/{uuid.uuid4().hex}", compression=None) as out:
            out.write("\n".join(n for m in messages if m is not None for n in m.files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        for name in (n for m in messages if m is not None for n in m.files):
            store.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format "warc" known to a session, with pushdown of predicates."""
    spark.conf.set(PUSHED, "true")
    spark.dataSource.register(WarcSource)


def _record_id(page: Column) -> Column:
    return F.coalesce(F.concat(F.lit("urn:page:"), F.url_encode(page.cast("string"))), F.lit("urn:page"))


def page_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """The record of each page, as the writer takes it."""
    rows = pages.select(col(page_id).alias("page"), col(url).cast("string").alias("url"), F.coalesce(col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    order = F.struct(F.col("page").isNull().alias("a"), "page", F.col("url").isNull().alias("b"), "url", "n")
    alike = rows.where("key IS NOT NULL").groupBy("key", "page", "url").agg(F.count("*").alias("n"))
    shared = cut(alike.groupBy("key").agg(F.sum("n").alias("rows"), F.min(order).alias("least")).where("rows > 1").select(
        F.col("key").alias("of"), "least.page", "least.url", "least.n").toDF("of", "first_page", "first_url", "first_n"))
    joined = rows.join(shared, F.col("key") == F.col("of"), "left")
    first = F.col("page").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))

    def record(df: DataFrame, response: Column) -> DataFrame:
        refers = F.when(~response, _record_id(F.col("first_page")))
        return df.select(
            F.when(response, "response").otherwise("revisit").alias("record_type"), _record_id(F.col("page")).alias("record_id"), F.col("url").alias("target_uri"),
            refers.alias("refers_to"), "payload")

    if shared.where("first_n > 1").isEmpty():
        return record(joined, F.col("of").isNull() | first)
    # Rows alike in everything that is written: one of them is the response. Only they are gathered, one row for each group.
    twins = F.col("of").isNotNull() & first & (F.col("first_n") > 1)
    one = joined.where(twins).groupBy("of").agg(*[F.first(c).alias(c) for c in ("page", "url", "payload", "first_page", "first_n")])
    copies = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("first_n"))))
    return record(joined.where(~twins), F.col("of").isNull() | first).unionByName(record(copies, F.col("copy") == 1))


def write_pages(pages: DataFrame, path: str | None = None, **options) -> str:
    """Writes the pages' records to archives in the folder `path`, a new one of the shared folder if None; gives its path."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    page_records(pages, **options).write.format("warc").mode("append").option("path", path).save()
    return path


def read_pages(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages in the archives at `path`.

    Responses are read whole and held against their digests; revisits tell their payload's length and digest in headers.
    kind: the type of page_id.
    """
    register(spark)
    head = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    read = lambda schema, which: spark.read.format("warc").schema(schema).load(path).where(F.col("record_type") == which)
    whole = read(f"{head}, payload binary", "response").withColumn("payload_bytes", F.length("payload").cast("long")).drop("payload")
    page = lambda c: F.url_decode(F.when(F.col(c).startswith("urn:page:"), F.substring(c, 10, 1 << 20))).cast(kind)
    both = whole.unionByName(read(head, "revisit"))
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
