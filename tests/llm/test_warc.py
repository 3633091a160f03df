"""Archives: round trips, foreign files, predicates judged on headers, what isn't decoded, commits."""

import base64
import gzip
import hashlib
import io
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import warc


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def _plain(rows, least=0):
    """(page_id, bytes, digest, type, refers to) by a dict of payloads; rows are (page_id, url, html)."""
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        seen = len(payload) >= least and payload in first
        first.setdefault(payload, page)
        out.append((page, len(payload), _digest(html), "revisit" if seen else "response", first[payload] if seen else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", ""), (4, "http://c", None), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n\r\nHTTP/1.1 200\r\n\r\n"),
    (7, "u", "same"), (7, "u", "same"), (7, "v", "same"), (8, "w", "same"), (None, "u", "same"), (None, "u", "lone"), (9, "u", "\r\n\r\n"), (10, "u", "\r\n\r\n"),
]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, i, "z") for i, r in enumerate(rows)], "page_id long, url string, html string, payload int, Record_Type string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, folder, least):
    path = warc.write_pages(_pages(spark, ROWS), f"{folder}/a", min_bytes=least)
    found = warc.read_pages(spark, path).collect()
    assert sorted((tuple(r) for r in found), key=repr) == _plain(ROWS, least)
    whole = spark.read.format("warc").load(path)
    assert whole.schema.simpleString() == "struct<" + warc.COLUMNS.replace(", ", ",").replace(" ", ":").replace("long", "bigint") + ">"
    texts = {r.record_id: r.payload for r in whole.where("record_type = 'response' AND record_id <> 'urn:page'").collect()}
    assert {k: bytes(v).decode() for k, v in texts.items()} == {f"urn:page:{p}": h or "" for p, _, h in ROWS if p is not None and any(x[0] == p and x[3] == "response" for x in _plain(ROWS, least))}
    assert whole.where("record_id = 'urn:page:1'").first().target_uri == "http://a/%0D%0AX:%20y"
    assert whole.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_empty_table_and_text_ids(spark, folder):
    assert warc.read_pages(spark, warc.write_pages(_pages(spark, ROWS[:0]), f"{folder}/a")).count() == 0
    rows = spark.createDataFrame([("a b/é", None, "x"), ("ü+%", "u", "x"), ("", "u", "y")], "page_id string, url string, html string")
    found = warc.read_pages(spark, warc.write_pages(rows, f"{folder}/b"), "string").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [("", "response", None), ("a b/é", "response", None), ("ü+%", "revisit", "a b/é")]


def test_only_committed_files_count_and_files_are_cut(spark, folder):
    pages = _pages(spark, [(i, "u", f"text {i}" * 50) for i in range(200)])
    warc.register(spark)
    for _ in range(2):
        warc.page_records(pages).write.format("warc").mode("append").option("path", f"{folder}/a").option("file_bytes", 2000).save()
    files = [f for f in os.listdir(f"{folder}/a") if f.endswith(".gz")]
    assert len(files) > 8 and max(os.path.getsize(f"{folder}/a/{f}") for f in files) < 3000
    with open(f"{folder}/a/part-lost.warc.gz", "wb") as lost:
        lost.write(b"not an archive")
    read = spark.read.format("warc").schema("record_id string").option("partition_bytes", 5000).load(f"{folder}/a")
    assert read.count() == 400 and 4 <= read.rdd.getNumPartitions() < len(files)


def _foreign(records):
    return [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{key}>\r\nContent-Length: {len(block)}\r\nContent-Type: text/plain\r\nX-Long: a\r\n b\r\n\r\n".encode() + block + b"\r\n\r\n" for kind, key, block in records]


@pytest.mark.parametrize("packed", ["plain", "members", "one member"])
def test_foreign_files(spark, folder, packed):
    parts = _foreign([("warcinfo", "i", b"software: x"), ("resource", "r", b"\r\n\r\nWARC/1.0\r\n" * 9000), ("metadata", "m", b""), ("resource", "s", b"last")])
    data = b"".join(parts) if packed == "plain" else gzip.compress(b"".join(parts)) if packed == "one member" else b"".join(map(gzip.compress, parts))
    name = f"{folder}/x.warc" + ("" if packed == "plain" else ".gz")
    with open(name, "wb") as out:
        out.write(data)
    warc.register(spark)
    read = spark.read.format("warc").load(name)
    assert [(r.record_id, r.content_bytes, r.payload_bytes, r.headers["x-long"]) for r in read.collect()] == [("urn:i", 11, 11, "a b"), ("urn:r", 126000, 126000, "a b"), ("urn:m", 0, 0, "a b"), ("urn:s", 4, 4, "a b")]
    assert [bytes(r.payload) for r in read.where("record_type IN ('resource', 'x') AND content_bytes < 100").collect()] == [b"last"]
    with open(name, "wb") as out:
        out.write(data[: len(data) - 40])
    with pytest.raises(Exception, match="ends within|between|no gzip"):
        spark.read.format("warc").load(name).collect()


def test_predicates_are_pushed(spark, folder):
    path = warc.write_pages(_pages(spark, ROWS), f"{folder}/a")
    read = spark.read.format("warc").load(path)
    by, some = F.col, read.drop("payload", "headers")
    everything = spark.createDataFrame(some.collect(), some.schema)
    for where in (by("record_type") == "revisit", by("refers_to").isNull(), by("record_id").isin("urn:page:3", "urn:page:9"), by("target_uri").startswith("http://"),
                  (by("content_bytes") >= 100) & (by("content_bytes") < 200), by("record_id") > "urn:page:5", by("payload_bytes") > 10, by("refers_to") != "urn:page:1"):
        count = lambda df: sorted(r.record_id for r in df.select("record_id").collect())
        assert count(read.where(where)) == count(everything.where(where))
    reader = warc.WarcReader({"path": path}, read.schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.GreaterThan(("payload_bytes",), 10), warc.IsNotNull(("headers", "x"))]))
    assert len(left) == 2 and len(reader.filters) == 1


def test_unwanted_payloads_are_neither_read_nor_inflated():
    big = os.urandom(3_000_000)
    data = b"".join(warc.member(warc.record_bytes("response", f"urn:page:{i}", None, None, big if i % 2 else b"small"), 1) for i in range(6))

    class Counted(io.BytesIO):
        taken = 0

        def readinto(self, into):
            n = super().readinto(into)
            Counted.taken += n
            return n

    stream = warc.Stream(Counted(data), "x")
    inflated = []
    more = stream._more
    stream._more = lambda: (more(), inflated.append(len(stream.kept)))[0]
    rows = list(warc.records(stream, ["record_id", "payload"], lambda row: row["record_id"].endswith(("0", "2", "4"))))
    assert [r[1] for r in rows] == [b"small"] * 3 and Counted.taken < len(data) / 3 and sum(inflated) < 20_000
    rows = list(warc.records(warc.Stream(Counted(data), "x"), ["record_id", "payload_bytes"], lambda row: True))
    assert [r[1] for r in rows] == [5, len(big)] * 3


def test_a_changed_payload_is_told():
    record = warc.record_bytes("response", "urn:page:1", None, None, b"abc").replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    with pytest.raises(ValueError, match="differs from its digest"):
        list(warc.records(warc.Stream(io.BytesIO(record), "x"), ["payload"], lambda row: True))
