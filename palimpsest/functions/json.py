"""JSON of unknown shape, in Arrow UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: States of a fact.
FACT_STATES = ("stated", "explicitly_none", "not_found", "unknown", "parsing_failed", "conflict", "resolved_update")


def without_trailing_commas(text: str) -> str:
    """Without commas before a closing bracket, those in strings aside."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] if m[1] is not None else m[2], text)


def clean_json(text: str | None) -> str | None:
    """A reply's JSON: without a code fence and trailing commas; null if it still isn't JSON."""
    if text is None:
        return None
    body = text.strip()
    if m := re.fullmatch(r"```[a-zA-Z]*\s*\n?(.*?)\n?\s*```", body, re.DOTALL):
        body = m[1]
    body = without_trailing_commas(body.strip())
    try:
        json.loads(body)
    except ValueError:
        return None
    return body


@F.pandas_udf(StringType())
def lenient_json(x: pd.Series) -> pd.Series:
    return x.map(clean_json)


@F.pandas_udf(StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """Sorted keys, no blanks; equal for equal values. Null stays null."""
    return x.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def set_at(value: object, pointer: str, new: object) -> object:
    """value with `new` at a JSON pointer; a path that isn't there is ignored."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    at = value
    for i, part in enumerate(parts):
        if isinstance(at, list):
            if not part.isdigit() or int(part) >= len(at):
                return value
            part = int(part)
        elif not isinstance(at, dict) or part not in at:
            return value
        if i == len(parts) - 1:
            at[part] = new
        else:
            at = at[part]
    return value


@F.pandas_udf(StringType())
def pointer_set(x: pd.Series, pointer: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else json.dumps(set_at(json.loads(t), p, n), ensure_ascii=False) for t, p, n in zip(x, pointer, new)])


def facts(value: object, path: str = "") -> list[dict]:
    """Every fact in a tree: an object with a known state."""
    found = []
    if isinstance(value, dict):
        if value.get("state") in FACT_STATES:
            quotes = [e.get("quote") for e in value.get("evidence") or [] if isinstance(e, dict)]
            found.append({"path": path, "value": json.dumps(value.get("value"), ensure_ascii=False), "state": value["state"], "quotes": quotes})
        for k, v in value.items():
            found += facts(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            found += facts(v, f"{path}/{i}")
    return found


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType()), StructField("state", StringType()), StructField("quotes", ArrayType(StringType()))])))
def walk_facts(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [] if t is None else facts(json.loads(t)))
