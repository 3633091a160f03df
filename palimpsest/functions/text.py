"""Text functions as Column expressions; Arrow UDFs only where Spark has no builtin."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def collapse_space(x: Column) -> Column:
    """Runs of white space, Unicode's too, become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def compact(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def trigrams(x: Column) -> Column:
    """Distinct 3-grams of x with two spaces before and one behind it; an empty or null x has none."""
    padded = F.concat(F.lit("  "), x, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays of distinct values; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(0.0)).otherwise(both / total)


def name_similarity(a: Column, b: Column) -> Column:
    """0 if one is empty, 1 if equal, 0.9 if the shorter has six letters or more and lies in the longer, else trigram Jaccard."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    short = F.when(F.length(a) == low, a).otherwise(b)
    long = F.when(F.length(a) == low, b).otherwise(a)
    return (
        F.when(F.coalesce(low, F.lit(0)) == 0, F.lit(0.0)).when(a == b, F.lit(1.0))
        .when((low >= 6) & (high > low) & F.contains(long, short), F.lit(0.9)).otherwise(jaccard(trigrams(a), trigrams(b)))
    )


def normalize_name(x: Column, markers: list[str]) -> Column:
    """Lower case, without revision markers, letters and digits only."""
    marked = F.regexp_replace(F.lower(x), "|".join(map(re.escape, markers)), "") if markers else F.lower(x)
    return F.regexp_replace(marked, "[^0-9a-z가-힣]", "")


def contains_compact(block: Column, quote: Column) -> Column:
    """Whether the quote lies in the block if white space doesn't count at all."""
    return F.contains(compact(block), compact(quote))


def contains_collapsed(block: Column, quote: Column) -> Column:
    """Whether the quote lies in the block if runs of white space count as one space."""
    return F.contains(collapse_space(block), collapse_space(quote))


def strip_nul(x: Column) -> Column:
    return F.translate(x, "\u0000", "")


def mask_secret(x: Column) -> Column:
    """First and last four characters of a long value, else stars."""
    return F.when(F.length(x) > 12, F.concat(F.left(x, F.lit(4)), F.lit("..."), F.right(x, F.lit(4)))).otherwise(F.lit("***"))


def parse_amount(x: Column) -> Column:
    """A non-negative whole amount such as '3,500,000원' or '1,200'; else null."""
    digits = F.regexp_replace(F.trim(x), r"[,\s]|원$", "")
    return F.when(F.rlike(digits, F.lit(r"^[0-9]+$")), digits.cast("bigint"))


def amount_label(kind: Column, low: Column, high: Column, percent: Column) -> Column:
    """A reader's label of an amount: won in units of 10,000 where whole, per cent, range or maximum."""

    def won(v: Column) -> Column:
        whole = (v % 10000 == 0) & (v >= 10000)
        return F.when(whole, F.concat(F.format_number((v / 10000).cast("long"), 0), F.lit("만원"))).otherwise(F.concat(F.format_number(v, 0), F.lit("원")))

    return (
        F.when(kind == "percentage", F.concat(percent.cast("string"), F.lit("%"))).when(kind == "fixed", won(high))
        .when(kind == "maximum", F.concat(F.lit("최대 "), won(high))).when(kind == "range", F.concat(won(low), F.lit("~"), won(high)))
        .otherwise(F.lit("금액 미상"))
    )


@F.pandas_udf(StringType())
def nfkc_lower(x: pd.Series) -> pd.Series:
    """Unicode NFKC, then lower case."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
def quote_offsets(block: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where the quote stands in the block, white space being free; null if nowhere."""

    def find(b, q):
        words = (q or "").split()
        m = re.search(r"\s+".join(map(re.escape, words)), b or "") if words else None
        return (None, None) if m is None else m.span()

    return pd.DataFrame([find(b, q) for b, q in zip(block, quote)], columns=["start", "stop"], dtype="Int32")
