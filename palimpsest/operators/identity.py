"""Identity: comparing editions, proposals, merges and splits. Similarity only ever proposes; a decision row merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import least_gap_days
from palimpsest.functions.edition import edition_tokens
from palimpsest.operators.lineage import cut

SAME, DIFFERENT, GAP_DAYS = 0.82, 0.55, 150


def _disjoint(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def signature(
    name: Column, *, fact_years: Column | None = None, fact_terms: Column | None = None, deadlines: Column | None = None, starts: Column | None = None
) -> Column:
    """The struct that `verdict` compares: what facts state (arrays; none if left out) and what the name says, apart."""
    said, none = edition_tokens(name), F.array().cast("array<string>")
    dates = F.array().cast("array<date>")
    return F.struct(
        F.coalesce(none if fact_years is None else fact_years, none).alias("fact_years"), said["years"].alias("name_years"),
        F.coalesce(none if fact_terms is None else fact_terms, none).alias("fact_terms"), said["terms"].alias("name_terms"),
        said["halves"].alias("halves"), said["rounds"].alias("rounds"), said["cohorts"].alias("cohorts"),
        F.coalesce(dates if deadlines is None else deadlines, dates).alias("deadlines"), F.coalesce(dates if starts is None else starts, dates).alias("starts"))


def verdict(score: Column, left: str, right: str) -> Column:
    """same, different_edition, uncertain or different, by rules in this order.

    Signatures are structs of string arrays (fact_years, name_years, fact_terms, name_terms, halves, rounds, cohorts) and
    date arrays (deadlines, starts). What facts state and what names say is compared apart.
    """
    l, r = (lambda f, p=p: F.col(f"{p}.{f}") for p in (left, right))
    conflict = F.lit(False)
    for f in ("fact_years", "name_years", "fact_terms", "name_terms", "halves", "rounds", "cohorts"):
        conflict = conflict | _disjoint(l(f), r(f))
    conflict = conflict | F.coalesce(least_gap_days(l("deadlines"), r("deadlines")) > GAP_DAYS, F.lit(False))
    one_sided = F.lit(False)
    for f in ("rounds", "cohorts"):
        one_sided = one_sided | ((F.size(l(f)) > 0) != (F.size(r(f)) > 0))
    shared = lambda f: F.coalesce(F.arrays_overlap(l(f), r(f)), F.lit(False))
    anchor = shared("fact_years") | shared("name_years") | shared("deadlines") | shared("starts")
    return (
        F.when(score < DIFFERENT, "different").when(conflict, "different_edition").when(one_sided, "uncertain")
        .when((score >= SAME) & anchor, "same").otherwise("uncertain"))


def proposals(pairs: DataFrame, *, subject: str, candidate: str, verdict_name: str = "verdict", score: str = "score", top: int = 3) -> DataFrame:
    """The first `top` candidates of each subject that may be the same: 'same' before 'uncertain', then by score."""
    order = F.when(F.col(verdict_name) == "same", 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(order, F.col(score).desc(), candidate))
    kept = pairs.where(F.col(verdict_name).isin("same", "uncertain")).withColumn("place", rank).where(F.col("place") <= top)
    return kept.withColumn("decision", F.lit("proposed"))


def winner(left: str, right: str, *, published: str, created: str, key: str) -> Column:
    """Of two records the one that is published, else the older, else of smaller key."""
    of = lambda p: F.struct((~F.col(f"{p}.{published}")).alias("a"), F.col(f"{p}.{created}").alias("b"), F.col(f"{p}.{key}").alias("c"))
    return F.least(of(left), of(right))["c"]


def in_force(decisions: DataFrame, *, key: str = "id", reverses: str = "reverses") -> DataFrame:
    """Decisions that no later one reverses."""
    undone = decisions.where(F.col(reverses).isNotNull()).select(F.col(reverses).alias("__undone"))
    return decisions.where(F.col(reverses).isNull()).join(undone, F.col(key) == F.col("__undone"), "left_anti")


def follow_redirects(redirects: DataFrame, *, source: str, target: str, most: int = 40) -> DataFrame:
    """(source, final): the end of each chain of redirects, by pointer doubling, so in rounds logarithmic in its length.

    Each round is cut, and the last is the one that changes nothing. ValueError for a cycle, which has no end.
    """
    chain = cut(redirects.select(F.col(source).alias("k"), F.col(target).alias("to")))
    for _ in range(most):
        step = chain.select(F.col("k").alias("to"), F.col("to").alias("next"))
        moved = cut(chain.join(step, "to", "left").select("k", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        chain = moved.select("k", "to")
        if moved.where("moved").isEmpty():
            return chain.select(F.col("k").alias(source), F.col("to").alias("final"))
    raise ValueError("redirects form a cycle")


def match_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """(notice, pos, record, how): a notice's new items matched to its records, each record once, in the items' order.

    items (notice, pos, name, mark), records (notice, record, name, mark, previous): mark is a `signature`; previous is the
    number of items of the extraction that made the record's last version. An item takes the one record that no item before
    it took and that `verdict` finds the same; several such leave it without one. If none is the same, a notice's only item
    takes its only record, unless that is another edition or came from an extraction with more items: how is then slot, or
    renamed where the verdict is different, which people have to see. how is null without a record.

    The items of a notice, which a notice bounds, are folded in the JVM with the records taken so far as the state.
    """
    from palimpsest.functions.edition import core_name
    from palimpsest.functions.text import name_similarity

    side = lambda df, key, p, *more: df.select("notice", key, core_name(F.col("name")).alias(f"{p}_core"), F.col("mark").alias(p), *more)
    pairs = side(items, "pos", "left").join(side(records, "record", "right", F.col("previous").cast("long").alias("previous")), "notice", "left")
    ruled = F.when(F.col("record").isNotNull(), F.struct("record", verdict(name_similarity(F.col("left_core"), F.col("right_core")), "left", "right").alias("verdict"), "previous"))
    each = pairs.groupBy("notice", "pos").agg(F.array_sort(F.collect_list(ruled)).alias("found"))
    notices = each.groupBy("notice").agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("items"))
    pos, record = items.schema["pos"].dataType.simpleString(), records.schema["record"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{record}>").alias("taken"), F.array().cast(f"array<struct<pos:{pos},record:{record},how:string>>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        found = item["found"]
        free = F.filter(found, lambda r: ~F.array_contains(state["taken"], r["record"]))
        same = F.filter(free, lambda r: r["verdict"] == "same")
        only = F.try_element_at(found, F.lit(1))
        slot = (F.size(same) == 0) & (F.size("items") == 1) & (F.size(found) == 1) & (F.size(free) == 1) & (only["verdict"] != "different_edition") & (only["previous"] == 1)
        taken = F.when(F.size(same) == 1, F.try_element_at(same, F.lit(1))["record"]).when(slot, only["record"])
        how = F.when(F.size(same) == 1, "same").when(slot, F.when(only["verdict"] == "different", "renamed").otherwise("slot"))
        out = F.struct(item["pos"].alias("pos"), taken.alias("record"), how.alias("how"))
        return F.struct(F.when(taken.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(taken))).alias("taken"), F.concat(state["out"], F.array(out)).alias("out"))

    return notices.select("notice", F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select("notice", "x.*")
