"""Evidence rows from extracted trees: each tree is walked beside its blocks and warnings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Trees that are walked at once.
TREES = 512


_ENCODE = json.JSONEncoder(ensure_ascii=False).encode


def _facts(value: object, path: str, out: list[tuple]) -> list[tuple]:
    """(path, object) of all objects with a list of evidence."""
    if isinstance(value, dict):
        if isinstance(value.get("evidence"), list):
            out.append((path, value))
        for k, v in value.items():
            if k != "evidence" and isinstance(v, (dict, list)):
                _facts(v, f"{path}/{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, (dict, list)):
                _facts(v, f"{path}/{i}", out)
    return out


def _said(value: dict) -> tuple[str, object]:
    """(value, state) of what evidence stands for."""
    if "value" in value and "state" in value:
        return _ENCODE(value["value"]), value["state"]
    return _ENCODE({k: v for k, v in value.items() if k != "evidence"}), "stated"


def references(value: object, path: str) -> Iterator[tuple]:
    """Every evidence reference of a tree, with the path, value and state of what it stands for.

    An object with value, state and evidence is a fact; of another object with a list of evidence the rest is the value, and
    it is stated.
    """
    for at, fact in _facts(value, path, []):
        said, state = _said(fact)
        for i, e in enumerate(fact["evidence"]):
            if isinstance(e, dict):
                yield at, i, e.get("block_id"), e.get("quote"), e.get("evidence_type"), said, state


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else _ENCODE(value)


def _known(tree: str | None, base: str, blocks: dict[str, list], wrong: list[str], out: list[tuple]) -> None:
    """Appends (document, block, path, value, quote, kind, status, verification) of a tree's references to its blocks; none of what is no JSON."""
    try:
        parsed = json.loads(tree) if tree is not None else None
    except ValueError:
        return
    for path, fact in _facts(parsed, base, []):
        said = None
        for i, e in enumerate(fact["evidence"]):
            if not isinstance(e, dict) or (documents := blocks.get(block := _text(e.get("block_id")))) is None:
                continue
            said = said or _said(fact)
            kind = e.get("evidence_type")
            pending = kind == "inferred" or (bool(wrong) and f"{path}/evidence/{i}" in wrong)
            status = "conflicting" if said[1] == "conflict" else "candidate" if pending else "accepted"
            for document in documents:
                out.append((document, block, path, said[0], _text(e.get("quote")), _text(kind), status, "pending" if pending else "verified"))


def evidence_rows(trees: DataFrame, blocks: DataFrame, warnings: DataFrame, *, key: str, tree: str, base: str = "") -> DataFrame:
    """(key, document, block_id, path, value, quote, kind, status, verification) of all references to known blocks.

    blocks: (key, block_id, document); warnings: (key, warning), each a reference's path (path/evidence/position), a colon and
    what is wrong. A reference that is warned of, or that is inferred, is pending, else verified; one to a conflict is
    conflicting, one that is pending a candidate, else accepted.

    A tree meets its blocks and warnings as a row, so its references aren't dealt again; a key's blocks have to fit into one.
    """
    own = blocks.where("block_id IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("block_id", "document")).alias("__blocks")).select(key, F.col("__blocks.block_id").alias("__blocks"), F.col("__blocks.document").alias("__documents"))
    wrong = warnings.groupBy(key).agg(F.collect_set(F.substring_index("warning", ":", 1)).alias("__wrong"))
    rows = trees.select(key, F.col(tree).alias("__tree")).join(own, key).join(wrong, key, "left").select(key, "__tree", "__blocks", "__documents", "__wrong")
    document = blocks.schema["document"].dataType
    names = [key, "document", "block_id", "path", "value", "quote", "kind", "status", "verification"]
    schema = StructType([rows.schema[key], StructField("document", document), *[StructField(n, StringType()) for n in names[2:]]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TREES):
                batch = whole.slice(start, TREES)
                at, found = [], []
                for i, (text, known, documents, wrong) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3, 4)])):
                    of = {}
                    for b, document in zip(known, documents):
                        of.setdefault(b, []).append(document)
                    before = len(found)
                    _known(text, base, of, wrong or [], found)
                    at += [i] * (len(found) - before)
                kind = batch.schema.field("__documents").type.value_type
                columns = list(zip(*found)) if found else [()] * 8
                arrays = [pa.array(c, kind if j == 0 else pa.string()) for j, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=names)

    return rows.mapInArrow(walk, schema)
