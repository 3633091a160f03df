"""The moment of asking, and lists with a limit."""

from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates
from palimpsest.operators.ranking import capped_lists


@pytest.mark.parametrize("moment,want", [
    (datetime(2024, 2, 29, 14, 59, 59, tzinfo=UTC), ("2024-02-29", 86399)),
    (datetime(2024, 2, 29, 15, 0, tzinfo=UTC), ("2024-03-01", 0)),
    (datetime(2024, 1, 1, 0, 0, tzinfo=timezone(timedelta(hours=9))), ("2024-01-01", 0)),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_clock_is_the_zones(spark, moment, want, zone):
    """Whatever the session's zone is."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        asked = dates.clock(moment)
        row = spark.range(1).select(asked.today.cast("string").alias("today"), asked.second.alias("second")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == want


def test_clock_needs_an_offset():
    with pytest.raises(ValueError):
        dates.clock(datetime(2024, 1, 1))


def test_capped_lists(spark):
    rows = [(None, i) for i in range(5)] + [("a", i) for i in range(3)] + [("b", 1), ("b", 1)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {(r.k, r.v, r.place, r.n_left_out) for r in capped_lists(df, ["k"], [F.col("v")], limit=3).collect()}
    assert got == {(None, i, i + 1, 2) for i in range(3)} | {("a", i, i + 1, 0) for i in range(3)} | {("b", 1, 1, 0), ("b", 1, 2, 0)}
    assert capped_lists(df.where("false"), ["k"], [F.col("v")], limit=1).count() == 0
    plan = capped_lists(df, ["k"], [F.col("v")], limit=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it
    for limit in (0, 501):
        with pytest.raises(ValueError):
            capped_lists(df, ["k"], [F.col("v")], limit=limit)
