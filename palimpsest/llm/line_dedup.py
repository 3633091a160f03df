"""Line deduplication by spread over sites: boilerplate lines that many sites share are removed.

Lines are the text's parts between line feeds, keyed by two 64-bit hashes of the line without spaces, tabs and carriage
returns at its ends. Each key's HyperLogLog sketch of sites is built and merged by aggregation. A key whose estimate is
within `margin` of `min_sites` gets an exact count of sites; others are settled by the estimate (with 2**12 registers its
standard error is 1.6 %, so the default margin is over 15 of these). A line on `min_sites` sites or more is removed from every
document but the one of least id that holds it.

Cases. A blank line is never removed; a null site counts as no site; a null text stays null and has no lines; repeated rows
are one document; a document that loses every line has an empty text; ties of the least id go to the least text hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import col, cut, text_hash, without
from palimpsest.llm.routing import maybe_in

MIN_SITES, MARGIN, LG_REGISTERS = 8, 0.25, 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame, text: str, site: str, doc_id: str) -> DataFrame:
    rows = docs.select(col(doc_id).alias("id"), text_hash(text).alias("th"), col(site).cast("string").alias("site"), F.posexplode(_lines(col(text))).alias("pos", "line"))
    line = F.btrim("line", F.lit(" \t\r"))
    return rows.where(line != "").select("id", "th", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def spread_lines(docs: DataFrame, *, text: str = "text", site: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """(h1, h2, first): keys of lines on min_sites sites or more, and the document that keeps the line."""
    return _spread(_keyed(docs, text, site, doc_id), **options)


def _spread(lines: DataFrame, *, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th"))
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sites"), first.alias("first"))
    guessed = cut(sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= min_sites * (1 - margin)))
    near, sure = (guessed.where(where) for where in (F.col("n") <= min_sites * (1 + margin), F.col("n") > min_sites * (1 + margin)))
    # Sites are counted of the keys near the threshold only: other lines stay in their scan.
    pairs = maybe_in(lines.where("site IS NOT NULL").select("h1", "h2", "site"), near, "h1", "h2").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).join(near.select("h1", "h2", "first"), ["h1", "h2"])
    return cut(sure.select("h1", "h2", "first").unionByName(exact.select("h1", "h2", "first")))


def remove_spread_lines(docs: DataFrame, *, text: str = "text", site: str = "source", doc_id: str = "doc_id", prefix: str = "", **options) -> DataFrame:
    """docs with the text without spread lines, and n_lines and n_removed, their names after `prefix`."""
    lines = _keyed(docs, text, site, doc_id)
    spread = _spread(lines, **options)
    mine = F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.th").eqNullSafe(F.col("th"))
    gone = maybe_in(lines.select("h1", "h2", "id", "th", "pos"), spread, "h1", "h2").join(spread, ["h1", "h2"]).where(~mine)
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("pos").alias("__gone"))
    base = docs.select(*[col(c) for c in without(docs, f"{prefix}n_lines", f"{prefix}n_removed")])
    joined = base.join(gone, col(doc_id).eqNullSafe(F.col("__id")) & text_hash(text).eqNullSafe(F.col("__th")), "left")
    lines = _lines(col(text))
    clean = F.when(F.col("__gone").isNull(), col(text)).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n"))
    return joined.select(
        *[clean.alias(c) if c == text else col(c) for c in base.columns],
        F.when(col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(f"{prefix}n_removed"),
    )
