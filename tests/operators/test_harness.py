"""Hand cases of raising checks, proceeds, corrections and histories walked backwards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import bakeoff, factors, universe


def rows(df) -> set:
    return set(map(tuple, df.collect()))


def test_a_check_that_raises_loses_no_other(spark, tmp_path):
    cells = spark.createDataFrame([("p", "a", "1"), ("p", "b", "x")], "provider string, entry string, text string")
    good = bakeoff.finding(cells, "good", F.lit("pass"), F.col("text"))
    checks = {"good": lambda: good, "runs": lambda: bakeoff.finding(cells, "runs", F.lit("pass"), F.expr("cast(raise_error(text) as string)")), "plans": lambda: bakeoff.finding(cells, "plans", F.col("none"), F.lit(""))}
    found = rows(bakeoff.run_checks(checks, cells.select("provider", "entry"), str(tmp_path / "run")).select("check", "entry", "outcome"))
    assert found == {("good", e, "pass") for e in "ab"} | {(c, e, "error") for c in ("runs", "plans") for e in "ab"}


def test_a_mergers_cash_comes_before_a_delisting(spark):
    day = date(2020, 1, 1)
    fields = "action_id bigint, security_id string, action_type string, ex_date date, available_on date, amount double, currency string, reason string"
    actions = [
        (1, "a", "delisting", day, day, None, None, "failure"), (2, "a", "merger", day, day, 2.0, "GBP", None), (3, "b", "delisting", day, day, None, None, "failure"),
        (4, "c", "delisting", day, day, None, None, "acquired"), (5, "d", "merger", day, day, 1.0, "USD", None), (6, "e", "delisting", day, date(2021, 1, 1), None, None, "failure"), (7, "f", "merger", day, day, None, None, None),
    ]
    units = spark.createDataFrame([(s, "GBX") for s in "abcdef"], "security_id string, unit string")
    found = {r.security_id: (r.proceeds, r.warning is None) for r in factors.action_proceeds(spark.createDataFrame(actions, fields), units, F.lit(date(2020, 6, 1))).collect()}
    assert found == {"a": (200.0, True), "b": (0.0, True), "c": (None, True), "d": (None, False)}


def test_a_correction_meets_exactly_one_change(spark):
    one, two = date(2020, 1, 1), date(2020, 2, 1)
    events = spark.createDataFrame([("u", one, "x", "added", ""), ("u", one, "y", "added", "n"), ("u", one, "y", "removed", "n")], "universe string, effective date, name string, change string, notes string")
    moved = [(1, "u", one, "x", two, "late"), (2, "u", one, "y", two, "late"), (3, "u", two, "x", one, "late")]
    fixed, faults = universe.corrected(events, spark.createDataFrame(moved, "correction int, universe string, effective date, name string, new_effective date, reason string"))
    assert rows(fixed) == {("u", two, "x", "added", "[corrected: late]"), ("u", one, "y", "added", "n"), ("u", one, "y", "removed", "n")}
    assert rows(faults) == {(2, 2), (3, 0)}


def test_a_history_walked_backwards(spark):
    day = lambda n: date(2020, 1, n)
    # x joined on the 3rd, y left on the 5th, z changed places on the 5th, w's addition is missing at the end, v never changed
    events = [("x", day(3), "added"), ("y", day(5), "removed"), ("z", day(5), "removed"), ("z", day(5), "added"), ("w", day(7), "added")]
    changes = spark.createDataFrame([("u", s, d, c) for s, d, c in events], "universe string, security_id string, effective date, change string")
    start, days = universe.reverse_replay(changes, spark.createDataFrame([("u", s) for s in "xzv"], "universe string, security_id string"))
    assert rows(start) == {("u", "y"), ("u", "z"), ("u", "v")}
    assert rows(days) == {("u", day(7), 3, 1), ("u", day(5), 4, 0), ("u", day(3), 3, 0)}
