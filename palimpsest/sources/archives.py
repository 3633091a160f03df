"""Files inside archives, within limits."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

MEMBERS, TOTAL, ONE = 250, 200 << 20, 50 << 20


def members(content: bytes | None) -> tuple[list[tuple[str, bytes]], list[str]]:
    """((name, bytes) of the members, flags): no more than the limits allow, no archive within an archive."""
    found, flags, total = [], [], 0
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        return [], ["unreadable"]
    for i, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
        if i >= MEMBERS:
            flags.append("too_many")
            break
        if info.file_size > ONE or info.filename.lower().endswith(".zip"):
            flags.append("skipped")
            continue
        total += info.file_size
        if total > TOTAL:
            flags.append("too_large")
            break
        found.append((info.filename, archive.read(info)))
    return found, sorted(set(flags))


def section_text(content: bytes) -> list[str]:
    """Paragraph texts of the sections of a zipped XML document, in order."""
    out = []
    for name, data in sorted(members(content)[0]):
        if re.search(r"section[0-9]+\.xml$", name, re.IGNORECASE):
            for p in ElementTree.fromstring(data).iter():
                if p.tag.rpartition("}")[2] == "p":
                    text = "".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t").strip()
                    if text:
                        out.append(text)
    return out


@F.pandas_udf(StructType([StructField("members", ArrayType(StructType([StructField("name", StringType()), StructField("content", BinaryType())]))), StructField("flags", ArrayType(StringType()))]))
def unpack(content: pd.Series) -> pd.DataFrame:
    rows = [members(c) for c in content]
    return pd.DataFrame({"members": [[{"name": n, "content": b} for n, b in m] for m, _ in rows], "flags": [f for _, f in rows]})
