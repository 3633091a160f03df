"""Resolving a field that several notices state: stated intent decides, never recency or confidence."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("agreed", "resolved_explicit_update", "unresolved", "not_stated")


def resolve(candidates: list[dict], directives: list[dict], pending: list[dict]) -> dict:
    """One field of one scope. Candidates (key, value as JSON); directives (key, selected, superseded keys, verified);
    pending (key, verified). A directive that isn't verified or names unknown keys is ignored, and noted."""
    blocked = any(p.get("verified") for p in pending)
    if not candidates:
        return {"outcome": "unresolved" if blocked else "not_stated", "selected": None, "notes": []}
    keys = [c["key"] for c in candidates]
    for problem, bad in (("duplicate candidate", len(set(keys)) < len(keys)), ("candidate without a value", any(c.get("value") is None for c in candidates)),
                         ("duplicate directive", len({d["key"] for d in directives}) < len(directives))):
        if bad:
            raise ValueError(problem)
    if blocked:
        return {"outcome": "unresolved", "selected": None, "notes": ["pending amendment"]}
    notes, edges = [], set()
    for d in sorted(directives, key=lambda d: d["key"]):
        old = set(d["superseded"])
        if not d.get("verified") or not old or d["selected"] in old or not (old | {d["selected"]}) <= set(keys):
            notes.append(f"ignored {d['key']}")
            continue
        edges |= {(o, d["selected"]) for o in old}
    left, waiting = dict.fromkeys(keys, 0), [*edges]
    for _, new in edges:
        left[new] += 1
    ready, seen = [k for k in keys if not left[k]], 0
    while ready:
        k = ready.pop()
        seen += 1
        for old, new in waiting:
            if old == k:
                left[new] -= 1
                if not left[new]:
                    ready.append(new)
    if seen < len(keys):
        return {"outcome": "unresolved", "selected": None, "notes": [*notes, "cycle"]}
    gone = {old for old, _ in edges}
    sinks = sorted(k for k in keys if k not in gone)
    values = {json.dumps(json.loads(c["value"]), sort_keys=True) for c in candidates if c["key"] in sinks}
    if len(values) > 1:
        return {"outcome": "unresolved", "selected": None, "notes": [*notes, "disagreement"]}
    return {"outcome": "resolved_explicit_update" if gone else "agreed", "selected": sinks[0], "notes": notes}


def resolve_fields(candidates: DataFrame, directives: DataFrame, scope: Sequence[str], pending: DataFrame | None = None) -> DataFrame:
    """(scope, outcome, selected) for scopes of any shape, in batches of gathered fields: candidates (scope, key, value), directives
    (scope, key, selected, superseded array, verified), pending amendments (scope, key, verified). A group is one field of
    one record; a verified pending amendment leaves it unresolved, and one with pending amendments alone isn't stated."""
    gather = lambda df, name, *fields: df.groupBy(*scope).agg(F.collect_list(F.struct(*fields)).alias(name))
    fields = gather(candidates, "__c", "key", "value").join(gather(directives, "__d", "key", "selected", "superseded", "verified"), list(scope), "full")
    if pending is not None:
        fields = fields.join(gather(pending, "__p", "key", "verified"), list(scope), "full")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = [[[] if x is None else list(x) for x in rows[c]] if c in rows else [[]] * len(rows) for c in ("__c", "__d", "__p")]
            found = [resolve(*group) for group in zip(*parts)]
            yield rows[list(scope)].assign(outcome=[x["outcome"] for x in found], selected=[x["selected"] for x in found])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.select(*scope).schema.fields)
    return fields.mapInPandas(run, f"{names}, outcome string, selected string")


def resolve_acyclic(candidates: DataFrame, superseded: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The same by joins alone, where valid directives form no cycle: superseded (scope, key) leave, the rest has to agree."""
    gone = superseded.select(*scope, "key").distinct().withColumn("__gone", F.lit(True))
    marked = candidates.join(gone, [*scope, "key"], "left")
    stays = F.col("__gone").isNull()
    found = marked.groupBy(*scope).agg(
        F.collect_set(F.when(stays, F.col("value"))).alias("__values"), F.min(F.when(stays, F.col("key"))).alias("__least"), F.bool_or(~stays).alias("__some"))
    agrees = F.size("__values") == 1
    outcome = F.when(~agrees, "unresolved").when(F.col("__some"), "resolved_explicit_update").otherwise("agreed")
    return found.select(*scope, outcome.alias("outcome"), F.when(agrees, F.col("__least")).alias("selected"))
