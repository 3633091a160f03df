"""What a second review may settle by itself, and what goes to people."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What of a draft may be corrected, by the kind of value.
TEXT = ("title", "summary", "provider_name", "administrator_name", "support_summary", "eligibility_summary", "application_instructions", "selection_process", "round_label")
WHOLE = ("selection_capacity", "academic_year")
CHOICES = {
    "selection_capacity_scope": ("final_selection", "university_nomination"), "academic_term": ("spring", "summer", "fall", "winter", "annual", "other", "unknown"),
}
#: Fields of the rows under a draft, by the list that they are in.
ROWS = {
    "windows": {"start_date": "date", "end_date": "date", "start_time": "time", "end_time": "time", "raw_text": "text", "conditions_text": "text"},
    "benefits": {"amount_kind": "amount_kind", "amount_min": "amount", "amount_max": "amount", "raw_text": "text", "conditions_text": "text"},
    "required_documents": {"name": "text", "condition": "text"},
    "contacts": {"email": "text", "phone": "text", "person": "text", "department": "text", "organization": "text"},
}
AMOUNT_KINDS = ("fixed", "maximum", "range", "percentage", "formula", "variable", "unknown")
#: Kinds that a review judges, and outcomes by what it says.
JUDGED = ("identity_uncertain", "revision_candidate")
OUTCOMES = {"dismiss": "dismissed", "fix": "corrected", "merge": "merged", "revise": "revised"}


def reviewable(kind: Column, has_flags: Column) -> Column:
    """Judgements, and other items with quality flags; failures of the system go to people at once."""
    return F.coalesce(kind.isin(*JUDGED) | ((kind == "other") & has_flags), F.lit(False))


def _is(kind: str, value: Column) -> Column:
    """Whether a text is a value of that kind."""
    tests: dict[str, Callable[[Column], Column]] = {
        "text": lambda v: F.lit(True),
        "date": lambda v: F.rlike(v, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(v, "yyyy-MM-dd").isNotNull(),
        "time": lambda v: F.rlike(v, F.lit(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")),
        "amount": lambda v: F.rlike(F.regexp_replace(v, r"[,\s원]", ""), F.lit(r"^\d+(\.\d+)?$")),
        "amount_kind": lambda v: v.isin(*AMOUNT_KINDS),
        "whole": lambda v: F.rlike(v, F.lit(r"^\d+$")),
    }
    return tests[kind](value)


def correctable(path: Column, value: Column) -> Column:
    """Whether a correction (path, value as text) is of a field that may be corrected, and its value of the field's kind.

    A path is a field of the draft, list/entry/field of a row, list/entry for a whole row, which can only be removed (null), or
    required_documents/- for a new document, which needs a name. Null clears any field.
    """
    parts = F.split(F.trim(path, F.lit("/")), "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    n, first, known = F.size(parts), at(1), F.lit(False)
    own = F.when(first.isin(*TEXT), F.lit(True)).when(first.isin(*WHOLE), _is("whole", value))
    for name, choices in CHOICES.items():
        own = own.when(first == name, value.isin(*choices))
    known = known | ((n == 1) & (first.isin(*TEXT, *WHOLE, *CHOICES)) & (value.isNull() | own))
    for name, fields in ROWS.items():
        of = F.lit(False)
        for field, kind in fields.items():
            of = of | ((at(3) == field) & (value.isNull() | _is(kind, value)))
        entry = (at(2) != "-") & (at(2) != "")
        known = known | ((first == name) & entry & (((n == 3) & of) | ((n == 2) & value.isNull())))
    return F.coalesce(known | ((n == 2) & (first == "required_documents") & (at(2) == "-") & (F.trim(value) != "")), F.lit(False))


def review_outcome(item: Column, said: Column) -> Column:
    """What becomes of an item: people, escalated, dismissed, corrected, merged or revised.

    item: struct (kind, entity, has_flags, published, related: ids, own: ids); said: struct (verdict, confidence, corrections: array
    of (path, value), same: ids, revisions: array of (target, merged: ids)). Only a sure verdict is carried out, and only if its
    action fits the item: corrections of an unpublished draft's quality item, all of them allowed; a merge of two or more of
    the related ids; revisions of a revision candidate, each of another target, whose merged ids are the amendment's own.
    """
    sure = F.coalesce((said["confidence"] == "high") & said["verdict"].isin(*OUTCOMES), F.lit(False))
    quality = (item["kind"] == "other") & (item["entity"] == "opportunity_version")
    corrections, revisions, same = (F.coalesce(said[f], F.array()) for f in ("corrections", "revisions", "same"))
    distinct = F.array_distinct(same)
    targets = F.transform(revisions, lambda r: r["target"])
    fits = (
        F.when(said["verdict"] == "fix", quality & ~F.coalesce(item["published"], F.lit(False)) & (F.size(corrections) > 0) & F.forall(corrections, lambda c: correctable(c["path"], c["value"])))
        .when(said["verdict"] == "merge", (item["kind"] == "identity_uncertain") & (F.size(distinct) >= 2) & (F.size(F.array_except(distinct, item["related"])) == 0))
        .when(said["verdict"] == "revise", (item["kind"] == "revision_candidate") & (F.size(revisions) > 0) & (F.size(F.array_distinct(targets)) == F.size(targets))
              & F.forall(revisions, lambda r: F.size(F.array_except(F.coalesce(r["merged"], F.array()), item["own"])) == 0))
        .otherwise(F.lit(True)))
    outcome = F.lit(None).cast("string")
    for verdict, name in OUTCOMES.items():
        outcome = F.when(said["verdict"] == verdict, name).otherwise(outcome)
    return F.when(~reviewable(item["kind"], item["has_flags"]), "people").when(sure & F.coalesce(fits, F.lit(False)), outcome).otherwise("escalated")
