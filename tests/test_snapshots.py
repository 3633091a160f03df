"""Differences of snapshots against a comparison of all rows; what of unchanged data isn't read; the four guards."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.snapshots import changes, guard_violations, write_snapshot

SCHEMA = "k long, parent long, sealed string, name string"


def _plain(before, after):
    b, a = ({r[0]: r for r in rows} for rows in (before, after))
    how = lambda k: "added" if k not in b else "deleted" if k not in a else "changed" if a[k] != b[k] else None
    return {k: how(k) for k in b.keys() | a.keys() if how(k)}


def _found(spark, before, after, width=8):
    snaps = [write_snapshot(spark.createDataFrame(rows, SCHEMA).repartition(3), key="k", width=width) for rows in (before, after)]
    return snaps, changes(spark, *snaps)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_are_all_and_only_those(spark, seed):
    r = random.Random(seed)
    keys = r.sample(range(-3000, 3000), 1200) + [1 << 61, -(1 << 61)]
    before = [(k, r.choice([None, 1, 2]), r.choice([None, "s"]), r.choice([None, "", "é"])) for k in keys]
    after = [row if r.random() > 0.03 else (*row[:3], "other") for row in before if r.random() > 0.02] + [(k, 1, None, "new") for k in range(10_000, 10_040)]
    _, found = _found(spark, before, after)
    assert {x.key: x.how for x in found.collect()} == _plain(before, after)


def test_nothing_and_everything(spark):
    rows = [(i, 1, None, "x") for i in range(50)]
    for before, after in ((rows, rows), (rows, []), ([], rows), ([], [])):
        assert {x.key: x.how for x in _found(spark, before, after)[1].collect()} == _plain(before, after)
    with pytest.raises(ValueError):
        write_snapshot(spark.createDataFrame([(1, 1, None, "x")] * 2, SCHEMA), key="k")
    with pytest.raises(ValueError):
        write_snapshot(spark.createDataFrame([(None, 1, None, "x")], SCHEMA), key="k")


def test_unchanged_data_is_not_read(spark):
    before = [(i, 1, None, f"x{i}") for i in range(4000)]
    after = [(i, p, s, "other" if i == 777 else n) for i, p, s, n in before] + [(5000, 1, None, "new")]
    snaps, _ = _found(spark, before, after)
    read = 0
    for snap in snaps:
        for file in glob.glob(f"{snap.path.removeprefix('file:')}/rows/**/*.parquet", recursive=True):
            if "__folder=6/" in file or "__folder=39/" in file:  # keys 768 to 895, 4992 to 5119
                read += 1
            else:
                # A file that can't be read: it would be told if it were.
                with open(file, "wb") as out:
                    out.write(b"no rows")
                os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    assert read == 3 and {x.key: x.how for x in changes(spark, *snaps).collect()} == {777: "changed", 5000: "added"}


def test_guards(spark):
    before = [(1, 7, None, "a"), (2, 7, "s", "b"), (3, 8, None, "c"), (4, 8, "s", "d"), (5, 9, None, "e"), (6, None, None, "f")]
    after = [(1, 8, None, "a"), (2, 7, "s", "B"), (3, 8, None, "c"), (5, 9, None, "E"), (6, 7, None, "f"), (9, 7, None, "new"), (10, 9, "s", "new")]
    _, found = _found(spark, before, after)
    rules = guard_violations(found, append_only=True, sealed="sealed", identity=["parent"], parent="parent", finalized=spark.createDataFrame([(7,)], "id long"))
    got = {}
    for x in rules.collect():
        got.setdefault(x.rule, {})[x.key] = x.how
    assert got == {
        "append_only": {1: "changed", 2: "changed", 4: "deleted", 5: "changed", 6: "changed"}, "sealed": {2: "changed", 4: "deleted"}, "identity": {1: "changed", 6: "changed"},
        "frozen_child": {1: "changed", 2: "changed", 6: "changed", 9: "added"}}
    assert found.where(F.col("how") == "changed").count() == 4
    with pytest.raises(ValueError):
        guard_violations(found)
