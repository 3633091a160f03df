"""Search predicates. Each keeps the three states of a fact apart: unknown isn't unrestricted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_member(column: str, value: str) -> Column:
    return F.array_contains(column, value)


def exists_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, condition: Column) -> DataFrame:
    """Parents with a child that meets the condition. Call it once for each EXISTS: two conditions may hold on two children."""
    found = children.where(condition).select(F.col(child_key).alias("__child"))
    return parents.join(found, F.col(key) == F.col("__child"), "left_semi")


def restricted_or_match(status: Column, match: Column) -> Column:
    """Can apply: not restricted (so unknown passes), or a match."""
    return (status != "restricted") | match


def bidirectional_prefix(values: Column, wanted: Column | str) -> Column:
    """Some value begins with the wanted one, or the wanted one with it."""
    w = F.lit(wanted)
    return F.exists(values, lambda v: F.startswith(v, w) | F.startswith(w, v))


def optional_equals(df: DataFrame, column: str, value: str) -> DataFrame:
    """An empty value filters nothing."""
    return df if value == "" else df.where(F.col(column) == value)


def status_filter(df: DataFrame, status: str, known: dict[str, Column]) -> DataFrame:
    """A status without a rule filters nothing."""
    return df.where(known[status]) if status in known else df


#: The regions that a question may name, long names and the short ones they stand for.
REGIONS = ("서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주")
LONG_REGIONS = {
    "충청북도": "충북", "충청남도": "충남", "전라북도": "전북", "전라남도": "전남", "경상북도": "경북", "경상남도": "경남", "경기도": "경기", "강원도": "강원",
}
#: How a question states each filter; of a filter's values the first that matches counts.
STATED = {
    "student_type": {"graduate": "대학원생|석사|박사", "undergraduate": "대학생|학부생"},
    "benefit_type": {"living_cost": "생활비", "tuition": "등록금", "housing": "주거|기숙사", "in_kind": "현물|서비스"},
    "status": {"active": r"모집\s*중|신청\s*가능|현재"},
}
#: This month, an amount from which on, an income bracket up to which, and where one lives.
THIS_MONTH = "이번 ?달"
AMOUNT_FROM = r"([0-9][0-9,]*)\s*(만)?\s*원\s*(?:이상|넘는|초과)"
BRACKET_TO = r"소득\s*([0-9]{1,2})\s*구간\s*(?:이하|까지)"
LIVING_IN = "(" + "|".join([*LONG_REGIONS, *REGIONS]) + r")(?:특별시|광역시|특별자치시|특별자치도|도)?\s*(?:거주|지역|사는|에\s*사는|출신|주민)"


def question_filters(question: Column, today: Column) -> Column:
    """struct of the filters that a Korean question states, null where it states none.

    Fields: student_type, benefit_type, status, end_from and end_to (dates), min_amount, income_bracket_max, region.
    """
    part = lambda pattern, group: F.nullif(F.regexp_extract(question, pattern, group), F.lit(""))
    number = lambda pattern: F.replace(part(pattern, 1), F.lit(","), F.lit("")).cast("bigint")
    monthly = F.rlike(question, F.lit(THIS_MONTH))
    region = part(LIVING_IN, 1)
    short = F.create_map(*[F.lit(x) for pair in LONG_REGIONS.items() for x in pair])
    values = {k: F.coalesce(*[F.when(F.rlike(question, F.lit(p)), F.lit(v)) for v, p in rules.items()]) for k, rules in STATED.items()}
    values |= {
        "end_from": F.when(monthly, today), "end_to": F.when(monthly, F.last_day(today)),
        "min_amount": number(AMOUNT_FROM) * F.when(part(AMOUNT_FROM, 2).isNull(), 1).otherwise(10_000),
        "income_bracket_max": number(BRACKET_TO), "region": F.coalesce(short[region], region),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def with_explicit(found: Column, explicit: dict[str, Column]) -> Column:
    """The filters of `question_filters`, each replaced by the value of `explicit` where that has one that isn't null."""
    names = (*STATED, "end_from", "end_to", "min_amount", "income_bracket_max", "region")
    return F.struct(*[(F.coalesce(explicit[k], found[k]) if k in explicit else found[k]).alias(k) for k in names])


def stated(filters: Column, conditions: dict[str, Callable[[Column], Column]]) -> Column:
    """Whether an item meets every filter that is stated; a filter without a condition filters nothing."""
    met = [filters[name].isNull() | F.coalesce(condition(filters[name]), F.lit(False)) for name, condition in conditions.items()]
    return reduce(lambda a, b: a & b, met, F.lit(True))


def admitted(items: DataFrame, questions: DataFrame, filters: str, conditions: dict[str, Callable[[Column], Column]], group: str) -> tuple[DataFrame, DataFrame]:
    """items and questions with the column `group`: a question's items are those of its group, which meet its filters.

    Questions with equal filters are one group, so an item comes once for each set of filters that admits it, however many
    questions state them. The filters' JSON is the group's name.
    """
    name = F.to_json(F.col(filters), {"ignoreNullFields": "false"}).alias(group)
    asked = questions.select("*", name)
    sets = asked.select(group, F.col(filters).alias("__filters")).dropDuplicates([group])
    return items.join(sets, stated(F.col("__filters"), conditions)).drop("__filters"), asked
