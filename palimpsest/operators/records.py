"""Rules on typed facts: application status, quality, window and benefit rows, effective values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of window that students apply in.
STUDENT_KINDS = ("application", "additional", "nomination")


def application_status(windows: DataFrame, keys: Sequence[str], *, today: str, second: int) -> DataFrame:
    """(keys, status) from windows (kind, start_date, start_second, end_date, end_second, closing_rule) at a moment.

    Students' kinds count, or all if there are none. A day-only end lasts all day. active: some dated window has begun
    and not ended, and has an end or isn't fixed; upcoming: some begins later; closed: all dated ones with an end have
    ended and there is one; else unknown.
    """
    day, now = F.lit(today).cast("date"), F.lit(second)
    start, end = F.col("start_date"), F.col("end_date")
    started = start.isNull() | (start < day) | ((start == day) & (F.col("start_second").isNull() | (F.col("start_second") <= now)))
    ended = F.coalesce((end < day) | ((end == day) & F.coalesce(F.col("end_second") < now, F.lit(False))), F.lit(False))
    dated = start.isNotNull() | end.isNotNull()
    flags = {
        "active": dated & started & ~ended & (end.isNotNull() | (F.col("closing_rule") != "fixed")),
        "upcoming": dated & start.isNotNull() & ~started,
        "open_end": dated & ~ended,
        "has_end": dated & end.isNotNull(),
    }
    student = F.col("kind").isin(*STUDENT_KINDS)
    marked = windows.select(*keys, student.alias("__student"), *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])
    both = marked.groupBy(*keys).agg(
        F.bool_or("__student").alias("__any"),
        *[F.bool_or(F.when(F.col("__student"), F.col(k))).alias(f"s_{k}") for k in flags], *[F.bool_or(k).alias(f"a_{k}") for k in flags])
    pick = lambda k: F.when(F.col("__any"), F.col(f"s_{k}")).otherwise(F.col(f"a_{k}"))
    status = F.when(pick("active"), "active").when(pick("upcoming"), "upcoming").when(pick("has_end") & ~pick("open_end"), "closed").otherwise("unknown")
    return both.select(*keys, status.alias("status"))


def overridden_status(status: Column, override: Column) -> Column:
    return F.when(override == "closed_by_source", "closed").otherwise(F.coalesce(override, status))


def quality(warnings: Column, conflict: Column, coverage: Column, partial: Column) -> Column:
    return F.when((warnings > 0) | conflict | (coverage != "complete"), "needs_review").when(partial, "partial").otherwise("complete")


def cleared_quality(conflict: Column, partial: Column) -> Column:
    """After a review: warnings no longer count."""
    return F.when(conflict, "needs_review").when(partial, "partial").otherwise("complete")


def confirmation(end_state: Column, end: Column) -> Column:
    return F.when(end_state == "conflict", "conflicting").when(end.isNotNull(), "confirmed").otherwise("unknown")


def closing_rule(stated: Column, end: Column) -> Column:
    return F.when(stated == "first_come", "until_filled").when(stated == "rolling", "rolling").when((stated == "fixed") & end.isNotNull(), "fixed").otherwise("unknown")


def benefit_shape(low: Column, high: Column, percent: Column) -> Column:
    """fixed, range, maximum, percentage or unknown; a bare minimum is no amount."""
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, "fixed").otherwise("range"))
        .when(high.isNotNull(), "maximum").when(percent.isNotNull(), "percentage").otherwise("unknown"))


def dimension_status(state: Column) -> Column:
    """unrestricted only if stated so; unknown is neither."""
    return F.when(state == "explicitly_none", "unrestricted").when(state.isin("stated", "resolved_update", "conflict"), "restricted").otherwise("unknown")


def fact_value(fact: Column) -> Column:
    """The value where the state says there is one."""
    return F.when(fact["state"].isin("stated", "resolved_update"), fact["value"])


def headcount_digits(x: Column) -> Column:
    """Digits of a placeholder headcount such as 00명; null for a number."""
    zeros = F.regexp_extract(x, "(?<![0-9])(0+)\\s*명", 1)
    return F.when(F.length(zeros) > 0, F.length(zeros))


#: Words in a title that tell a revision, in the order in which they are tried.
TITLE_MARKERS = (("취소|철회", "cancellation"), ("연장", "extension"), ("정정|수정", "correction"), ("변경", "change"), ("재게시|재공고", "repost"))


def title_revision(title: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, kind in TITLE_MARKERS:
        out = out.when(title.rlike(pattern), kind)
    return out


def review_action(kind: Column, confidence: Column, allowed: Sequence[str], kinds: Sequence[str]) -> Column:
    """What a second review may do: nothing for kinds it doesn't review, apply an allowed correction at high confidence, else escalate."""
    return F.when(~kind.isin(*kinds), "ignore").when(kind.isin(*allowed) & (confidence == "high"), "apply").otherwise("escalate")


def apply_revision(base: DataFrame, patches: DataFrame, *, version: str, new_version: Column, key: Sequence[str], value: str) -> DataFrame:
    """base's rows under a new version, with `value` from patches (key, value) where there is one, and `revised` saying so.

    base stays as it is: the caller appends the rows.
    """
    patch = patches.select(*key, F.col(value).alias("__new"), F.lit(True).alias("__has"))
    both = base.join(patch, list(key), "left")
    revised = F.coalesce(F.col("__has"), F.lit(False))
    return both.withColumns({version: new_version, value: F.when(revised, F.col("__new")).otherwise(F.col(value)), "revised": revised}).select(*base.columns, "revised")


#: Fixed value: the title of a version whose name wasn't found.
UNTITLED = "제목 확인 필요"


def assemble_versions(drafts: DataFrame, versions: DataFrame) -> DataFrame:
    """The version rows that drafts add to their records' histories; the caller appends them.

    drafts: record, pos (order within the extraction), name, provenance (array of flags), warnings (array), conflict, coverage,
    selected, nominated (numbers), benefits and conditions (arrays of texts). versions: record, version_no. A record's drafts
    follow its last version and each other. Result: record, pos, version_no, supersedes, edit_kind, title, quality,
    quality_flags, capacity, capacity_scope, support_summary, eligibility_summary. The final selection's number goes before
    the university's nomination; a negative one leaves its scope without a capacity. Empty parts of a summary are left out,
    and it is null if none is left.
    """
    last = versions.groupBy("record").agg(F.max("version_no").alias("__last"))
    place = F.row_number().over(Window.partitionBy("record").orderBy("pos"))
    before = F.coalesce("__last", F.lit(0)) + place - 1
    flags = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(F.coalesce("conflict", F.lit(False)), F.array(F.lit("field_conflict"))).otherwise(F.array().cast("array<string>")))
    provenance = F.coalesce("provenance", F.array().cast("array<string>"))
    state = quality(F.size("warnings"), F.coalesce("conflict", F.lit(False)), F.coalesce("coverage", F.lit("unknown")), F.size(provenance) > 0)
    number = F.coalesce("selected", "nominated")
    scope = F.when(F.col("selected").isNotNull(), "final_selection").when(F.col("nominated").isNotNull(), "university_nomination")
    joined = lambda c, by: F.nullif(F.array_join(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), by), F.lit(""))
    rows = drafts.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))).join(last, "record", "left").withColumn("__before", before)
    return rows.select(
        "record", "pos", (F.col("__before") + 1).cast("long").alias("version_no"), F.nullif(F.col("__before"), F.lit(0)).cast("long").alias("supersedes"),
        F.when(F.col("__before") == 0, "initial").otherwise("in_place_edit").alias("edit_kind"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(UNTITLED)).alias("title"), state.alias("quality"),
        F.when(state == "partial", F.concat(flags, provenance)).otherwise(flags).alias("quality_flags"), F.when(number >= 0, number).alias("capacity"), scope.alias("capacity_scope"),
        joined("benefits", "; ").alias("support_summary"), joined("conditions", "\n").alias("eligibility_summary"))


def resolve_subjects(audit: DataFrame, kinds: dict[str, tuple[DataFrame | None, Column | None, Column]], *, kind: str, entity: str) -> DataFrame:
    """audit with link and subject: what a row's (kind, entity) names, by one join over the subjects of all kinds.

    kinds: kind -> (rows, title, link). rows have `id`, title and link are columns over them. Rows of None make a kind
    without a table: its link is the same for all, and its subject is the entity itself where title isn't None. An entity that
    isn't there, or a kind that isn't known, has neither; a kind's own link is kept for an entity that isn't there only if
    it doesn't depend on the rows.
    """
    parts = [rows.select(F.lit(name).alias("__kind"), F.col("id").cast("string").alias("__id"), title.cast("string").alias("subject"), link.cast("string").alias("link"))
             for name, (rows, title, link) in kinds.items() if rows is not None]
    found = audit.join(reduce(DataFrame.unionByName, parts), (F.col(kind) == F.col("__kind")) & (F.col(entity).cast("string") == F.col("__id")), "left")
    plain = {name: (title, link) for name, (rows, title, link) in kinds.items() if rows is None}
    subject, link = F.col("subject"), F.col("link")
    for name, (title, its) in plain.items():
        link = F.when(F.col(kind) == name, its).otherwise(link)
        if title is not None:
            subject = F.when(F.col(kind) == name, title).otherwise(subject)
    return found.select(*[F.col(c) for c in audit.columns], link.alias("link"), subject.alias("subject"))
