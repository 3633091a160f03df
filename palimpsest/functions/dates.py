"""Date rules. The time of asking is always a parameter, never the clock."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


class Clock(NamedTuple):
    """One moment of asking, as constants of a zone: they are folded, so that filters on them reach the scan."""

    now: Column
    today: Column
    second: Column


def clock(moment: datetime, zone: str = ZONE) -> Clock:
    """The moment in the zone's time: now (timestamp_ntz), today, second of the day. ValueError without an offset."""
    if moment.utcoffset() is None:
        raise ValueError("the moment of asking needs its offset from UTC")
    utc = F.lit(moment.astimezone(UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    now = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return Clock(now, now.cast("date"), F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now))


def local_day(at: Column, zone: str = ZONE) -> Column:
    """The zone's date of a timestamp_ntz in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at).cast("date")


def deadline_state(end: Column, today: Column) -> tuple[Column, Column]:
    """(label, warn): D-n with a warning from seven days before, 'closed' after it, 'unknown' without a date."""
    left = F.datediff(end, today)
    label = F.when(end.isNull(), "unknown").when(left < 0, "closed").when(left == 0, "D-day").otherwise(F.concat(F.lit("D-"), left.cast("string")))
    return label, F.coalesce((left >= 0) & (left <= 7), F.lit(False))


def deadline_bucket(end: Column, today: Column) -> Column:
    """closed before today, closing up to 14 days ahead, open later, unknown without a date."""
    return (
        F.when(end.isNull(), "unknown").when(end < today, "closed").when(end <= F.date_add(today, 14), "closing").otherwise("open"))


def month_rest(today: Column) -> tuple[Column, Column]:
    return today, F.last_day(today)


def next_midnight(day: Column, time: Column) -> tuple[Column, Column]:
    """24:00 is 00:00 of the next day."""
    late = time == "24:00"
    return F.when(late, F.date_add(day, 1)).otherwise(day), F.when(late, F.lit("00:00")).otherwise(time)


def precision(day: Column, time: Column) -> Column:
    """unknown without a day; date without a time; minute or second by the time's form."""
    return F.when(day.isNull(), "unknown").when(time.isNull(), "date").when(F.length(time) > 5, "second").otherwise("minute")


def board_date(x: Column) -> Column:
    """YYYY.MM.DD, strictly; else null."""
    strict = F.rlike(x, F.lit(r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2}$"))
    return F.when(strict, F.try_to_date(x, "yyyy.MM.dd"))


def least_gap_days(left: Column, right: Column) -> Column:
    """Fewest days between a date of the one list and a date of the other; null if one is empty."""
    gaps = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.abs(F.datediff(a, b)))))
    return F.array_min(gaps)


def backoff_minutes(attempt: Column, transient: Column) -> Column:
    """10 * 3^(n-1) minutes after a transient error, else 2^n."""
    return F.when(transient, F.lit(10) * F.pow(F.lit(3), attempt - 1)).otherwise(F.pow(F.lit(2), attempt)).cast("bigint")
