"""What stands against publishing a version: each rule is a query of the versions that break it.

Tables, by name: versions (id, opportunity, quality), sources (version, notice_version, relationship, current, decision,
relation, run), notice_versions (id, notice, sealed, assets), runs (id, sealed, status), resolutions (id, version, status,
selected_evidence, selected_value, intent_evidence, cross_evidence), evidence (id, version, resolution, verified,
candidate, value, document), decisions (id, status, opportunity, other), documents (id, sealed, status), chunks (version,
document). Every rule is a join on keys and gives a version once; one that breaks several rules has a row for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that settle a field, and relations of a notice that amends another.
SETTLED = ("agreed", "resolved_explicit_update")
AMENDMENTS = ("extension", "correction", "cancellation", "reopened")


def _with(rows: DataFrame, other: DataFrame, key: str, p: str, how: str = "inner") -> DataFrame:
    """rows joined with other's columns, their names after `p`, where rows.key is other's id."""
    named = other.select(*[F.col(c).alias(f"{p}_{c}") for c in other.columns])
    return rows.join(named, F.col(key) == F.col(f"{p}_id"), how)


def publication_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(version, rule) of the versions that may not be published as they are."""
    versions, sources, evidence, resolutions = (tables[t] for t in ("versions", "sources", "evidence", "resolutions"))
    ids = versions.select(F.col("id").alias("version"))
    reviewed = versions.where("quality = 'needs_review'").select(F.col("id").alias("version"))
    current = sources.where("current")
    settled = F.coalesce(F.col("r_status").isin(*SETTLED), F.lit(False))
    decided = _with(evidence, resolutions.select("id", "status"), "resolution", "r", "left")
    mapped = _with(_with(sources, tables["notice_versions"], "notice_version", "n"), tables["runs"], "run", "x")
    chosen = _with(resolutions, evidence.select("id", "verified", "candidate", "value"), "selected_evidence", "e")
    named = resolutions.select("version", F.explode(F.array_compact(F.array("intent_evidence", "cross_evidence"))).alias("witness"))
    witness = _with(named, evidence.select("id", "verified", F.col("version").alias("of")), "witness", "e")
    amended = _with(_with(sources, tables["decisions"], "decision", "d", "left"), versions.select("id", "opportunity"), "version", "v")
    theirs = (F.col("d_opportunity") == F.col("v_opportunity")) | F.coalesce(F.col("d_other") == F.col("v_opportunity"), F.lit(False))
    # Only documents that a rule asks for meet the evidence, and only what meets them is dealt on.
    used = evidence.select("version", "document").union(tables["chunks"].select("version", "document"))
    doubtful = tables["documents"].where("NOT sealed OR status <> 'succeeded'")
    documents = _with(used, doubtful, "document", "d")
    complete = versions.where("quality = 'complete'").select(F.col("id").alias("version"))
    partly = _with(current, tables["notice_versions"], "notice_version", "n").where("n_assets <> 'complete'").select("version")
    partly = partly.union(documents.where("d_status <> 'succeeded'").select("version"))
    two = _with(current, tables["notice_versions"], "notice_version", "n").groupBy("version", "n_notice").agg(F.count("*").alias("n")).where("n > 1")

    def lacks(rows: DataFrame) -> DataFrame:
        return ids.join(rows.select("version"), "version", "left_anti")

    def unless_reviewed(rows: DataFrame) -> DataFrame:
        return rows.select("version").join(reviewed, "version", "left_anti")

    def where(rows: DataFrame, *conditions: Column) -> DataFrame:
        return rows.where(reduce(lambda a, b: a | b, conditions))

    rules = {
        "no source": lacks(sources),
        "unconfirmed source": where(mapped, F.col("relationship") != "confirmed", ~F.col("n_sealed"), ~F.col("x_sealed"), F.col("x_status") != "succeeded"),
        "open conflict": unless_reviewed(decided.where((F.col("candidate") == "conflicting") & ~settled)),
        "unresolved field": unless_reviewed(resolutions.where("status = 'unresolved'")),
        "value is not its evidence": where(chosen, ~F.col("e_verified"), F.col("e_candidate") != "accepted", ~F.col("e_value").eqNullSafe(F.col("selected_value"))),
        "witness of another version": where(witness, F.col("e_of") != F.col("version"), ~F.col("e_verified")),
        "superseded without decision": decided.where((F.col("candidate") == "superseded") & F.col("r_status").isNotNull() & ~settled),
        "two versions of one notice": two,
        "no watched source": lacks(current),
        "amendment without decision": where(
            amended, F.col("decision").isNotNull() & ~F.coalesce((F.col("d_status") == "confirmed") & theirs, F.lit(False)),
            F.col("relation").isin(*AMENDMENTS) & F.col("decision").isNull()),
        "unsealed document": where(documents, ~F.col("d_sealed"), ~F.col("d_status").isin("succeeded", "partial")),
        "incomplete provenance": partly.join(complete, "version", "left_semi"),
    }
    found = [rows.select("version").distinct().join(ids, "version", "left_semi").withColumn("rule", F.lit(rule)) for rule, rows in rules.items()]
    return reduce(DataFrame.unionByName, found)
